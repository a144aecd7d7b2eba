"""The registered queries: the library's operators over the given tables, and SQL to check them by."""
