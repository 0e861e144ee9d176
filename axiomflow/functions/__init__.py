"""Column functions: packed identifiers, IRIs, durations."""
