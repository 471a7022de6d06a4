"""Relational operators: DataFrame in, DataFrame out, lazy, with the clock passed in."""
