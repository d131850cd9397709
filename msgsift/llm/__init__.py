"""Training-data operators: dedup, language ID, token counts, mixing, secret scan, WARC,
toxicity, decontamination, LM scoring. Nothing else in the library imports this package."""
