"""Readers and writers: raw capture lines, Parquet partitions, JSONL queues, file manifests."""
