"""Training-data operators: near-dedup, toxicity, packing, token counts, media, archives, chat, secrets, decontamination, HTML."""
