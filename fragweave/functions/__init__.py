"""Column expressions: sequences, profiles, distances, probabilities."""
