"""Road-network analytics as Spark jobs: feeds, link tables, route choice, estimation."""
