"""Column functions: paths, text, ids, tokens and scores."""
