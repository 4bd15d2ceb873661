"""Scalar types and expressions."""
