"""Cleaning, scoring and display columns: Column in, Column out, no Python per row."""
