"""Column functions: text, citations, scores."""
