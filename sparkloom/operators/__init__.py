"""Fit, transform, predict and assess operators over DataFrames."""
