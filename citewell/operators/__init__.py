"""Set-at-a-time operators: DataFrames in, DataFrames out."""
