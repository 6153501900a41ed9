"""Session set-up, durable intermediate tables and test-table adapters."""
