"""Plan helpers: durable lineage cuts and session defaults."""
