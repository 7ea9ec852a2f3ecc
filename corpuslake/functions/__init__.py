"""Column functions: text, paths, links, vectors and glob patterns."""
