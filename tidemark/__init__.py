"""Event-study analytics over timestamped, scored text events and price bars, on Spark."""
