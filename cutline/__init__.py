"""Spark-native decision analytics: thresholds with overrides, batch eligibility, scoring, matching and retrieval."""
