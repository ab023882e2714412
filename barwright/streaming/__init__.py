"""streaming of the bar analytics engine."""
