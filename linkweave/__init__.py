"""Evidence linking and coordination analytics on Spark DataFrames."""
