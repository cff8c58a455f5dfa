"""Analytics over code and document knowledge on Spark."""
