"""Training-data operators: one module an operator, each usable on its own DataFrames.

``registry.queries()`` lists the thin ``opN_<name>`` queries and ``registry.oracle_sql()`` their DuckDB twins.
"""
