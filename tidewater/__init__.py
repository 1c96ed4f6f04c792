"""tidewater: a Spark-native engine for leakage-safe questions about timestamped data."""

__version__ = "0.1.0"
