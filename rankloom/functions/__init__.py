"""Scalar and array functions used by the operators."""
