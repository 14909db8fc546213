"""Reading: latest deliveries of a table, JSON Lines, keyed JSON, delimited files, and the page registry."""
