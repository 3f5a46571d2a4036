"""Analytics for labelled review streams, written as Spark DataFrame jobs."""
