"""Training-data operators: near-duplicate detection, scoring, extraction, sharding, mixing, archives, tokens.

Nothing outside this subpackage imports it; ``keyloom.llm.registry`` holds its queries.
"""
