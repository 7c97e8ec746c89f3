"""Training-data operators: near duplicates, secrets, decontamination, substring
dedup, mixing, toxicity, quality rules, PII, URL filters and chat formatting."""
