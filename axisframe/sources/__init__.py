"""Readers and writers for alignment and annotation files."""
