"""Column builders: scalar maths, text rules, fingerprints."""
