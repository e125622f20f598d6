"""Readers, writers and folders."""
