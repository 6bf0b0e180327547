"""Operators over records, channels, samples, segments and annotations, as DataFrame transformations."""
