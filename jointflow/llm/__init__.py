"""Operators for the making of training data: scans, models, searches, codes and filters over document tables."""
