"""Heliotable: survey, estimate and catalog processing on Spark DataFrames."""
