"""Source code: symbols, calls, structural search, conflicts, outlines."""
