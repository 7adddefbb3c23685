"""DataFrame operators: filters, routing, dedupe, registry, aggregates, joins."""
