"""See the package docstring of tapewell."""
