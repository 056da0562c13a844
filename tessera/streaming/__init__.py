"""Structured Streaming: indexes and derived tables that follow what arrives."""
