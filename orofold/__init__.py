"""Terrain and map-sheet analytics on Spark DataFrames."""
