"""Column functions: text and code normalisation, association measures."""
