"""Facts of source files: pure functions from text to rows, and the tables they make."""
