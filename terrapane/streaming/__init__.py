"""Incremental runs over file sources."""
