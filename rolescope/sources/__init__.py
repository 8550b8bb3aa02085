"""Readers and writers: posting payloads, JSON files, the company registry."""
