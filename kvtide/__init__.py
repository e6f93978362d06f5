"""kvtide: versioned key-value analytics expressed as Spark DataFrames."""
