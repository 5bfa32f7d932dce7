"""Table-to-table operators: cleaning, encoding, generation, metrics, privacy."""
