"""Gap filling and fusion of gridded satellite image time series on Spark."""
