"""operators of the tidewatch engine."""
