"""DataFrame operators: profiling, search, ranking, packing, training, evaluation."""
