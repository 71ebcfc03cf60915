"""Relational operators on points, chunk statistics and write logs. All are lazy DataFrame transformations."""
