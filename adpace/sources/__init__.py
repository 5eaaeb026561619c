"""Readers for exports, seeds and stored tables."""
