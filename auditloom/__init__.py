"""Spark-native analytics over crawled sites: audits, link graphs, snapshots, hierarchies."""

__version__ = "0.1.0"
