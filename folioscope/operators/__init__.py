"""Relational operators: directory views, search, bookmarks, suggestions, message log."""
