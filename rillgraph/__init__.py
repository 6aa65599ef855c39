"""Spreading-activation analytics over weighted graphs, as DataFrame operators for many queries at once."""
