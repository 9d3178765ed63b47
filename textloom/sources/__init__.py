"""Sources of the text-analytics engine."""
