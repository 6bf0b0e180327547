"""Readers and writers of recording files, annotation files and interchange formats."""
