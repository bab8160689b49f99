"""operators of cindertrail."""
