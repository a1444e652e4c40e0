"""Query builders over a directory of tables, and their SQL twins."""
