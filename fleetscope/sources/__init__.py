"""fleetscope.sources."""
