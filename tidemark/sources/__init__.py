"""Sessions, event tables, and the mapping of the test data to events."""
