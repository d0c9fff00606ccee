"""Reading and writing: page text, ingest requests, deal files, committed batches."""
