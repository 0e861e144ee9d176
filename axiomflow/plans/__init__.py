"""Driver loops: saturation, closures, placement."""
