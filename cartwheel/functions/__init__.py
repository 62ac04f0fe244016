"""Column helpers and the ordered / quantile building blocks."""
