"""Incremental forms of operators whose state is bounded."""
