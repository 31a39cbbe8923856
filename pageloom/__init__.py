"""News-page analytics on Spark: pages -> trees -> index items and articles."""
