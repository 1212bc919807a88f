"""Wakeline: vessel-movement and port-call analytics as PySpark DataFrame operators."""
