"""Plans: the round loop, the flagship query, and the catalogue of queries with their SQL."""
