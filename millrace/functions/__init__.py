"""Functions over DataFrames and columns that SQL lacks."""
