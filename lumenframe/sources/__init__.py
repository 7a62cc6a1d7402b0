"""Readers and writers of interchange formats."""
