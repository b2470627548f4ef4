"""Scalar functions and filters over keys."""
