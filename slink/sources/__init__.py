"""Table readers, file sinks and index / training stores."""
