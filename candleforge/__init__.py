"""Spark-native rule-mining analytics: bars, indicators, rules, simulation, statistics."""
