"""Readers of facts and rules."""
