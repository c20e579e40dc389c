"""Operators over log events and control tables."""
