"""fleetscope.operators."""
