"""Multi-tenant customer features, product co-occurrence and recommendations on Spark.

Every job takes DataFrames and returns DataFrames, for all tenants at once.
"""
