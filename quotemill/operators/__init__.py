"""DataFrame operators that the plans are made of."""
