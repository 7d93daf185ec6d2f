"""Scalar expressions and distribution functions."""
