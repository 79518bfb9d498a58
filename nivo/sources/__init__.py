"""Reading and writing tables, and weather payloads."""

from nivo.sources.tables import find, literal, read_or_default, read_table

__all__ = ["find", "literal", "read_or_default", "read_table"]
