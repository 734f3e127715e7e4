"""Analytics over SQL traffic (query logs and captured results) as Spark jobs."""
