"""Spark-native curation of labelled text and model outputs, and page-annotation preparation."""
