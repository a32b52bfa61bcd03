"""Analytics over media-library catalogues on Spark."""
