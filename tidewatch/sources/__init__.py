"""sources of the tidewatch engine."""
