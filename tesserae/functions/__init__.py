"""Scalar expressions, label rules, fixed configuration and pixel kernels."""
