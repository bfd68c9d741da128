"""Training-data operators: toxicity, BPE, quality, media, packing, counts, shards, language, near and exact dedup."""
