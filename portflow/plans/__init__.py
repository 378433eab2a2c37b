"""Plans: the model chain, the query registry and the DuckDB oracle SQL."""
