"""Job-posting analytics on Spark: ingest, clean, extract, upsert, search, report, match."""
