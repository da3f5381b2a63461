"""Table operators, one module per family; each is a function from DataFrames to a DataFrame."""
