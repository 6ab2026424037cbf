"""Structured-streaming form of the round log."""
