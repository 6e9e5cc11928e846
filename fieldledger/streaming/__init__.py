"""Continuous consumers of the change log."""
