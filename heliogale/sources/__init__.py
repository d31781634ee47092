"""Readers and writers for the long-table data model."""
