"""streaming of cindertrail."""
