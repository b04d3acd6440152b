"""Readers and the views that operators work on."""
