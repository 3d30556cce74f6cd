"""Named queries over the tables, with the SQL they are checked against."""
