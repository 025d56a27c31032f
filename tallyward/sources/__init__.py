"""Table contracts, readers, writers and the views over the driver tables."""
