"""Readers, writers and look-up services."""
