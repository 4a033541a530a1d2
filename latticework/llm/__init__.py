"""Operators for preparing training corpora.  Nothing outside imports this."""
