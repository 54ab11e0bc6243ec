"""Column builders: URLs, text and link predicates."""
