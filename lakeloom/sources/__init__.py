"""Readers: each returns a lazy DataFrame, or driver-side plans of what to read."""
