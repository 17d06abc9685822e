"""Star-catalogue analytics on PySpark: ingest, latest-per-key load, radius search, reports."""
