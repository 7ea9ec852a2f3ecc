"""An extension beyond the batch engine: a stream of notes that keeps the incremental plan going."""
