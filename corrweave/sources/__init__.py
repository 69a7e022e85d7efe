"""Readers of graphs and configurations, writers of results."""
