"""Table readers, writers and row generators."""
