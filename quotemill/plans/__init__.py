"""Cleaning transforms, marts, text signals, serving queries, and the registry of queries with their SQL."""
