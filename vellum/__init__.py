"""Vellum: document-graph analytics and training-data preparation on Spark."""
