"""Spark-native analytics over streams of short posts: clustering of near duplicates, timelines, label sets, and their evaluation."""
