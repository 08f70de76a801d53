"""Support-case analytics and tabular model training on Spark DataFrames."""
