"""A keyed-object query engine on Spark DataFrames."""
