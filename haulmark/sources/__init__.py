"""Readers, dimension tables and writers."""
