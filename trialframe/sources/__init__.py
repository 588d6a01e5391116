"""Readers for result trees."""
