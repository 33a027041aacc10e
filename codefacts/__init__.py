"""codefacts: extracts facts from source code and reference pages and analyses them as Spark tables."""
