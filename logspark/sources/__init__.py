"""Reading and writing log events: compact JSON lines, plain JSON, Windows records, the event store."""
