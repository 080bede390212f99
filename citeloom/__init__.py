"""Citation mining and claim matching on Spark."""

__version__ = "0.1.0"
