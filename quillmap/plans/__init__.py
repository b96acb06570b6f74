"""Named queries, derived inputs and join planning."""
