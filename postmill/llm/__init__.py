"""Training-data operators: quality, rules, toxicity, licences, personal data, packing,
sharding, secrets, decontamination, near-duplicate joins, infilling, fingerprints and periodic runs.

Nothing outside this subpackage imports it.
"""
