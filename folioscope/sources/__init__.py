"""Readers: the Python data source for page archives."""
