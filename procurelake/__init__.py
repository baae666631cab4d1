"""Spark-native cleaning, linking and analysis of public-procurement records."""
