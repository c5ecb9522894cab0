"""Basketry: retail analytics as ordinary Spark DataFrame operators."""
