"""Training-data operators: scoring, near duplicates, mixing, licences, decontamination, neighbours, sharding, repeats, personal data."""
