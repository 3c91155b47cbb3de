"""Registered query catalogue and the strategy comparison job."""
