"""Relational operators over sparse vectors in long form: one row for each (id, term, value)."""
