"""plans of cindertrail."""
