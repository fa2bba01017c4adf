"""Training-data operators on Spark DataFrames.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and ``oracles`` their SQL.
"""
