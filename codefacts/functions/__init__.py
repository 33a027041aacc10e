"""Column functions and the source-text parser."""
