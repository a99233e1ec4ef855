"""Operators over DataFrames: what the T-SQL front end is built on, and an API of its own."""
