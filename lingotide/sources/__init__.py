"""Readers and writers for sentence datasets, transcripts, audio catalogs and lexicons."""
