"""operators of the corpus engine."""
