"""DataFrame-to-DataFrame operators: filters, joins, spatial, aggregates, paths."""
