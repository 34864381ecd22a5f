"""Readers and writers of recordings, surveys and results."""
