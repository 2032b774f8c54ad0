"""Rainfall-frequency studies by storm relocation, as Spark DataFrames."""
