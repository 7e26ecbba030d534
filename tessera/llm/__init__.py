"""Training-data operators: deduplication, decontamination, privacy, tokens, language, quality."""
