"""The registered queries and their SQL statements."""
