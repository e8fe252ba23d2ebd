"""Job-level building blocks: lineage cuts, distributed ranking, registered queries."""
