"""Operators over versioned, permissioned relations: DataFrames in, a DataFrame out."""
