"""Evidence relations over tables, and the content-addressed store."""
