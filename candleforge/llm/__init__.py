"""Training-data operators: extraction, dedup, decontamination, tokenizers, scans, quality rules."""
