"""Readers and writers behind the catalog."""
