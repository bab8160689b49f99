"""sources of cindertrail."""
