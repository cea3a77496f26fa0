"""Jobs, iterative plans, metrics and recovery lines."""
