"""Building blocks shared by the operators: stored intermediates, sliced scans, exact quantiles, lookups."""
