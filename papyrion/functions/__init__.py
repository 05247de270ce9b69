"""Column expressions: strings, addresses, keys, labels."""
