"""Stateful operators, batch and streaming."""
