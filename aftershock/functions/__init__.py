"""Scalar column functions and the fixed domain values."""
