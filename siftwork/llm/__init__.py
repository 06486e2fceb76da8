"""Training-data operators: tokenisation, records, near-duplicate detection,
decontamination, extraction, sharding, quality rules, URL and secret filters.

Nothing outside this folder imports it."""
