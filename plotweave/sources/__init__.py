"""Readers and writers: tables, JSON payloads, book archives, artifacts."""
