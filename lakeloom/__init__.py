"""Data-warehouse lineage, term search and governed metrics on Spark DataFrames."""
