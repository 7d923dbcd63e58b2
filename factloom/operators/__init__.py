"""Relational and graph operators on fact tables."""
