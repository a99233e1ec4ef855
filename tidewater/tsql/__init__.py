"""The T-SQL front end: text to tokens, to a tree, to typed Spark SQL."""
