"""Column functions: sequences and motif matrices."""
