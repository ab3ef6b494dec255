"""Readers, writers and the mapping of order tables to surveillance roles."""
