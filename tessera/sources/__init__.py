"""Table readers and the shared scratch folder."""
