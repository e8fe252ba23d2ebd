"""streaming of the tidewatch engine."""
