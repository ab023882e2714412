"""plans of the bar analytics engine."""
