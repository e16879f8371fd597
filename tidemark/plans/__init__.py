"""Queries over the test tables with their DuckDB SQL, one module per family.

A module has QUERIES, name to function of (spark, directory), and SQL, name to text for the
queries that SQL can express.
"""
