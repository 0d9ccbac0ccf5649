"""Histograms over streams."""
