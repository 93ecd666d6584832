"""Constraint-aware data engine on PySpark."""
