"""Readers of raw captures and the domain tables."""
