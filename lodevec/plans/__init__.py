"""Plan building: pruning, catalogue of queries, SQL twins."""
