"""Conversion of molecules that keep arriving, and running counts of what converted."""
