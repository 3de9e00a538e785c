"""Staggered-treatment panel analytics as PySpark DataFrame operators."""
