"""Planning over run metadata and the catalogue of queries."""
