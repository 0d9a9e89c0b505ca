"""Field analytics on Spark: gridded, ensemble and irregular time series as typed DataFrames."""
