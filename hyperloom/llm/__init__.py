"""Training-data operators: fingerprints, joins, filters, classifiers, counts and mixing."""
