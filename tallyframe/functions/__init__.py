"""Column functions: labels and figures, page text, URLs and HTML."""
