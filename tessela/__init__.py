"""tessela: a Spark-native engine for study-content data.

Everything is a function from DataFrames to DataFrames; Catalyst and AQE pick
the physical plan.  ``tessela.plans`` holds the named queries.
"""
