"""Building, merging and querying histograms."""
