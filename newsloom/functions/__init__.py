"""functions of the corpus engine."""
