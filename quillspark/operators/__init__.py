"""DataFrame operators over the element relation; all are page-scoped and keep rows immutable."""
