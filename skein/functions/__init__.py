"""Skein subpackage."""
