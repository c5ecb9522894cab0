"""Composite jobs, and the binding of operators to the sample tables."""
