"""Structured Streaming: continuous ingest, live tails, rules on a stream."""
