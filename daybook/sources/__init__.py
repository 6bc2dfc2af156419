"""Readers, writers, catalog tables and the sample-table adapter."""
