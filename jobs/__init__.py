"""Jobs over the tables: each a function of a session and a configuration, with a command line."""
