"""Find out what changed in a set of tables and what that did to query results."""
