"""Operators over observation frames."""
