"""Text functions as native expressions: white space, tokens, rounding, URLs, fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space, as a regular-expression class.
SPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_SPACE_INNER = SPACE[1:-1]


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def strip_marks(text: Column) -> Column:
    """Without white space, full stops and dandas at either end."""
    edge = f"[{_SPACE_INNER}.\\u0964]+"
    return F.regexp_replace(text, f"^{edge}|{edge}$", "")


def blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(strip(text) == "", F.lit(True))


def tokens(text: Column) -> Column:
    """Runs of anything but white space; none for an empty text."""
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda t: t != "")


def pre_process(text: Column) -> Column:
    """As a string ('None' for null) with newlines as spaces, stripped."""
    return strip(F.replace(F.coalesce(text.cast("string"), F.lit("None")), F.lit("\n"), F.lit(" ")))


def rounded(value: Column, places: int) -> Column:
    """Rounded on the exact binary value, ties to even; infinities and NaN stay."""
    infinite = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(infinite, value).otherwise(F.call_function("format_number", F.when(infinite, F.lit(0.0)).otherwise(value), F.lit("0." + "0" * places)).cast("double"))


def quote_title(title: Column) -> Column:
    """A page title as a URL path: spaces as underscores, percent-encoded but for / _ . - ~."""
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def title_url(title: Column, code: Column) -> Column:
    return F.concat(F.lit("https://"), code, F.lit(".wikisource.org/wiki/"), quote_title(title))


def url_language(url: Column) -> Column:
    """First two characters of a URL after https://."""
    return F.substring(F.regexp_replace(url, "^https://", ""), 1, 2)


def path_part(path: Column, from_end: int) -> Column:
    """Part of a path by its place from the end, 1 the last; null where there's none."""
    return F.try_element_at(F.split(path, "/", -1), F.lit(-from_end))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def unfenced(text: Column) -> Column:
    """A reply without the code fence around it; fences count at the very ends alone."""
    opened = F.when(text.startswith("```json"), F.substr(text, F.lit(8))).when(text.startswith("```"), F.substr(text, F.lit(4))).otherwise(text)
    return strip(F.when(opened.endswith("```"), F.substr(opened, F.lit(1), F.length(opened) - 3)).otherwise(opened))


def mime_type(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".png"), "image/png").otherwise("image/jpeg")


def untouched_if_blank(text: Column, changed: Column) -> Column:
    """Blank and null texts as they are, others changed."""
    return F.when(blank(text), text).otherwise(changed)
