"""Usage-ledger analytics on Spark: ingest, dedup, price, roll up and watch token usage."""
