"""Column builders: text, location, skill, role and certification functions."""
