"""Flows composed of the operators."""
