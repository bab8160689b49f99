"""The search language over log events."""
