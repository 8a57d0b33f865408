"""Table operators: each is a pure function of DataFrames returning a DataFrame."""
