"""Part of the corpus engine; see README.md."""
