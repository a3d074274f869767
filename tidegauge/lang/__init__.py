"""The stream language: types, tree and parser."""
