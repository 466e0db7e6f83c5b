"""Running the stateless row operators and the document scorers on streams."""
