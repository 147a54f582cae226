"""Column functions: paths, release names, titles, scores, evidence."""
