"""Readers and writers of feed, network and matrix files."""
