"""DataFrame operators, one module per kind of work."""
