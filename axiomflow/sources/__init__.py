"""Readers and writers of ontologies, closures, logs and settings."""
