"""DataFrame operators: joins, per-key selection, codes, tabulation, reshaping."""
