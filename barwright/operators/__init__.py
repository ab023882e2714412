"""operators of the bar analytics engine."""
