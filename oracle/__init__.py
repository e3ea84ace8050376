"""Reference SQL for every registered query, written for DuckDB.

It states each result in the plain relational form (left joins with IS NULL,
cross joins, one join per leak type), not in the form the library runs.
"""
