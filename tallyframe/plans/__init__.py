"""Queries and the SQL they are held against."""
