"""Projections, rule checks, views, censuses and renderers."""
