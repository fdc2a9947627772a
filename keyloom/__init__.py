"""Analytics on keyed data structures, as DataFrame builders on Spark."""
