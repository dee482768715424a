"""arcwise: network-equilibrium analytics on Spark DataFrames."""
