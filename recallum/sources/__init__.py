"""Table readers, writers and shared storage."""
