"""An engine for analysing time-ordered bars: indicators, strategies, back-tests, search, walk-forward and permutation tests."""
