"""End-to-end queries, and the catalogue of queries the driver runs."""
