"""Axiom and fact operators as DataFrame transformations."""
