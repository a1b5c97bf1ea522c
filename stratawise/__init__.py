"""stratawise: layered, schema-discovered reference data on Spark DataFrames."""
