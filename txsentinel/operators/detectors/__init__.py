"""Detectors: fit on DataFrames, score into the long score table."""
