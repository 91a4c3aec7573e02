"""DataFrame operators: penetration cuts, block-level queries, comparisons and statistics."""
