"""DataFrame -> DataFrame operators (joins, windows, aggregates, reshapes, learning)."""
