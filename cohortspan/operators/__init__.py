"""Cohort operators: DataFrame in, DataFrame out."""
