"""DataFrame -> DataFrame operators, bound to tables by column name."""
