"""Operators that Spark has no single name for, composed of its own."""
