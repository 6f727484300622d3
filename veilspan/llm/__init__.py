"""Training-data operators: percentiles, quota sampling, PII, near duplicates,
secrets, packing, mixing and spam.  Nothing outside this folder imports it."""
