"""floorlens: analytics over portfolios of multi-floor buildings, on Spark."""
