"""Readers: files of drawings, models, terrain and configuration as DataFrames."""
