"""functions of cindertrail."""
