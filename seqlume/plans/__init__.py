"""Physical-plan helpers: scratch tables, skew handling, position bins."""
