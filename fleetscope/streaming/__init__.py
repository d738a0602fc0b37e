"""fleetscope.streaming."""
