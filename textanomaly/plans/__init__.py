"""Whole experiments put together from the operators."""
