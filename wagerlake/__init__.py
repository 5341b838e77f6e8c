"""Prediction-market analytics as DataFrame and SQL transformations."""
