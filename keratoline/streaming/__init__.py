"""Restartable incremental ingestion."""
