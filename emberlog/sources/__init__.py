"""Sources of log lines."""
