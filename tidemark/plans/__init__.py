"""Plans over many runs: grids, walk-forward, permutation tests, reports."""
