"""Readers, writers and collectors."""
