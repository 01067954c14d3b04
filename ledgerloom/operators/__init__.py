"""Distributed operators over chain tables."""
