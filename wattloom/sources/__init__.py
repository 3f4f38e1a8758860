"""Readers, writers and the adapters from the driver's tables."""
