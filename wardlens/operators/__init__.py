"""Generic DataFrame building blocks."""
