"""Readers and writers of intervals, sequences, motifs and tables."""
