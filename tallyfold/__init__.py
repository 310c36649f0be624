"""tallyfold: point-in-time time-series research on Spark DataFrames."""
