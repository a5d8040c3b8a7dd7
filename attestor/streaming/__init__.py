"""Event logs and state: the same functions serve batches and streams wherever Spark allows it."""
