"""Whole plans put together from operators."""
