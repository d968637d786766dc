"""Leak detection and findings analysis as Spark DataFrame operators."""

__version__ = "0.1.0"
