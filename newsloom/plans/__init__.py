"""plans of the corpus engine."""
