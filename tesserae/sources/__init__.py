"""Volumes, model folders and tensor files as DataFrames."""
