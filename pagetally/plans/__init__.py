"""Named reports over a folder of tables, and SQL to check them against."""
