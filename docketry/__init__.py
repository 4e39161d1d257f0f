"""Spark-native document mining: dated obligations, bank statements and their exports."""

__version__ = "0.1.0"
