"""Relational building blocks; each module is usable on its own."""
