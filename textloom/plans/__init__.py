"""Plans of the text-analytics engine."""
