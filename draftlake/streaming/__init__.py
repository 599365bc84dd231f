"""Structured Streaming: event windows, deduplicated enqueue, the leased queue, file ingestion."""
