"""Statistics, histograms, run logs and the whole benchmark run."""
