"""Domain plans built from the operators: pages, visits and ingestion."""
