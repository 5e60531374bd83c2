"""Spark-native cohort analytics over long multichannel recordings."""
