"""Spark-native stage-funnel analytics: observation logs, entity resolution, data quality and trend reports."""
