"""Training-data operators: packing, quality, chat, media, secrets, sharding, PII, decontamination, near-dedup, toxicity.

Nothing outside this subpackage imports it.
"""
