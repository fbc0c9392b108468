"""fieldloom: n-dimensional array, mesh and volume analytics as PySpark DataFrames."""
