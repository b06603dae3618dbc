"""Whole queries: derived input relations, their plans and their SQL."""
