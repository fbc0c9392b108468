"""Training-data operators (text, media and shard preparation)."""
