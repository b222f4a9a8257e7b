"""Property graphs over DataFrames, and how to load them."""
