"""Behaviour analytics on Spark."""
