"""Signal operators: array form (one array per row) and row form (signal_id, idx, sample)."""
