"""tabloom: wide-table quality gates, features, encodings, scoring and evaluation on Spark."""

__version__ = "0.1.0"
