"""Visit-sequence analytics on Spark: sequences, pairs, features, splits, vocabularies, ranking and exports."""
