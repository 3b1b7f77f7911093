"""Column functions: normalisation of text, names, dates and series, and similarity of titles and names."""
