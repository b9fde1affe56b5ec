"""Column functions: scalar text, geometry, phones and dates, scores, metrics."""
