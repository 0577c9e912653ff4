"""Plans: searches, the chunk store, indexing jobs and the registered queries."""
