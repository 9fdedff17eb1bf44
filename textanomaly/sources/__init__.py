"""Reading corpora, keeping stages, writing results."""
