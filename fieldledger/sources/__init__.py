"""Readers and writers: file-per-record stores, the native tables, test-table views."""
