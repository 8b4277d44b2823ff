"""Column builders: scalar text functions and question rules."""
