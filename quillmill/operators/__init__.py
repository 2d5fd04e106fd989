"""Relational operators over page geometry and document blocks."""
