"""Operators over note, chunk, vector and edge relations."""
