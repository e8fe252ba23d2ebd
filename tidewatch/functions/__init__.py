"""functions of the tidewatch engine."""
