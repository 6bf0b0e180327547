"""Column expressions: sample codecs, times, header lines."""
