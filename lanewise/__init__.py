"""lanewise: routing-decision analytics as declarative Spark jobs."""
