"""Readers and writers of draws."""
