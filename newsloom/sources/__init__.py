"""sources of the corpus engine."""
