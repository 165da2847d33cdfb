"""Reusable DataFrame operators shared by the three returns."""
