"""Operators for building training corpora: one module for each, one registry for their queries."""
