"""Training-data operators: search, toxicity, media, quality, chat, tokens, packing, mixing and three kinds of deduplication."""
