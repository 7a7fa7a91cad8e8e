"""Operators: DataFrame -> DataFrame functions on access logs."""
