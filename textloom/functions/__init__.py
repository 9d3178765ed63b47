"""Functions of the text-analytics engine."""
