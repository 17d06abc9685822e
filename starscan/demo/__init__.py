"""The operators applied to the test tables, with their SQL twins."""
