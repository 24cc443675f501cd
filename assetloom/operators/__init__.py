"""DataFrame operators: column shaping, joins, ranking, matching, upserts and links."""
