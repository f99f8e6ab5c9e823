"""Timeline analytics on Spark: intervals, signals, token sequences and plans over ordered, per-key time data."""
