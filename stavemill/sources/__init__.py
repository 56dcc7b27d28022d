"""Readers, writers, and the music views derived from the driver tables."""
