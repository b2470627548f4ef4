"""Journals as streams."""
