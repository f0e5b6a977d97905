"""Training-data pipeline operators: packing, mixing, sharding, extraction, URL filters, token files,
nearest neighbours, similarity joins, exact dedup, toxicity, line dedup, phrases and conversations.

Nothing outside this subpackage imports it; ``queries`` registers its query functions.
"""
