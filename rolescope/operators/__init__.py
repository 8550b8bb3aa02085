"""DataFrame-to-DataFrame building blocks: numbering, upsert, extraction, batches, matching."""
