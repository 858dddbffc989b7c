"""Table catalog, readers and writers."""
