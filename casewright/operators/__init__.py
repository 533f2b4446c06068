"""DataFrame operators: joins, aggregates, rankings and models."""
