"""Training-data operators: scoring, fingerprints, joins, tokenisation, archives and mixing."""
