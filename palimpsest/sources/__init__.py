"""Readers of catalogues, archives and configuration."""
