"""Column factories: window arithmetic and mergeable aggregate states."""
