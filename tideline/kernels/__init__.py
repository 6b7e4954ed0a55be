"""Numerical kernels: plain numpy, reached through grouped maps."""
