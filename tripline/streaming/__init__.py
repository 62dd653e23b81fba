"""An extension beyond batch work: consecutive pairs of a stream."""
