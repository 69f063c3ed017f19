"""DataFrame -> DataFrame operators: cleaning, aggregation, ordering, joins, quality."""
