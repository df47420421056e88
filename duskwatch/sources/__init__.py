"""Readers that turn files, exports and streams into DataFrames."""
