"""fleetscope.functions."""
