"""DataFrame operators: search, scoring, joins, reports, lifecycle, learning, text quality."""
