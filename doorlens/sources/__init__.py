"""Readers of landed files. Explicit schemas only; nothing is inferred."""
