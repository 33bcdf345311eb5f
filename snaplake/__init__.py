"""Versioned-snapshot analytics as plain functions from DataFrames to a DataFrame."""
