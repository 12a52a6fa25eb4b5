"""Statistics: histograms and selectivity estimates."""
