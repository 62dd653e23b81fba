"""DataFrame operators: relational helpers, sequences, profiles, features, sampling, splits, vocabularies, ranking, export."""
