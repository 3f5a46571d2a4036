"""Readers, writers and the reviews view."""
