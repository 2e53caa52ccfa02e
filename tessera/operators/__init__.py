"""Operators that turn documents into rows."""
