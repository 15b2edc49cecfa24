"""Index descriptions, index objects and their storage."""
