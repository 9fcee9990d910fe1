"""Named queries over the tables of a data folder, with the SQL that states the same result."""
