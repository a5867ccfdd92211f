"""Training-data operators: near-dedup, secrets, token output, media, decontamination,
mixing, HTML extraction, repeated passages, language ID and chat formatting.

Nothing else in the library imports this subpackage.
"""
