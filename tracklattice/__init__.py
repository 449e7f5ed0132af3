"""tracklattice: spatio-temporal analytics on Spark DataFrames."""
