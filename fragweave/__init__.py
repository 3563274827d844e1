"""Graph-assisted sequence clustering as DataFrame plans."""
