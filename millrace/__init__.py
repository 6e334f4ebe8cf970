"""millrace: a PySpark-native engine for trade, receipt and telemetry analytics."""
