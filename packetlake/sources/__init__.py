"""Readers, writers and stream endpoints."""
