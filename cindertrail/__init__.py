"""cindertrail: log and event analytics written as PySpark DataFrame plans."""

__version__ = "0.1.0"
