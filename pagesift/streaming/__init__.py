"""The same operators over arriving data."""
