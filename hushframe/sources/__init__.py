"""Tables: generated corpora and fixtures, the driver's Parquet, and JSON caches."""
