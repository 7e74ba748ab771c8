"""Readers with declared schemas, and text sources."""
