"""Spark operators for long tracks of points, and for the tables that are made from them."""
