"""Training-data operators: sharding, dedup, mixing, chat formatting, secrets, search, language ID, BPE."""
