"""A folder of recordings as a stream."""
