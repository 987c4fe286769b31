"""Operators on points, graphs, surfaces and networks."""
