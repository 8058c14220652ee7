"""A Spark-native engine for business records: reading, filtering, deduplicating, scoring, enriching and summarising."""
