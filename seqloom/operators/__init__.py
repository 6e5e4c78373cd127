"""Operators over intervals, sequences, motifs, features and models."""
