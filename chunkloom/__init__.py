"""Splitting, linking, searching and assembling text and source code as context for language models, on Spark."""

__version__ = "0.1.0"
