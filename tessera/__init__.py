"""Tessera: an analytics engine written directly on PySpark."""
