"""Whole simulations, from points to network."""
