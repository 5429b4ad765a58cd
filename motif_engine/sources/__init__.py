"""Readers of note events and their metadata."""
