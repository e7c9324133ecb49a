"""Readers: record files, advisory trees, source trees, archives, delimited files, test tables."""
