"""flowspark: network-flow detection analytics as plain PySpark DataFrame code."""

__version__ = "0.1.0"
