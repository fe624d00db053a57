"""DataFrame operators over channel groups."""
