"""Graph operators over ``vertices(id, ...)`` and ``edges(src, dst, ...)`` tables."""
