"""Training-data operators: scans, filters, near-duplicate search, packing and file formats on Spark."""
