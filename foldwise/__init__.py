"""Feature engineering, leak-safe encoding, evaluation and blending as plain Spark DataFrame functions."""

__version__ = "0.1.0"
