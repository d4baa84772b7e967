"""Part of lathework."""
