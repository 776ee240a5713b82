"""Partitioned inputs, dataset specifications, and proxy views over the star-schema test tables."""
