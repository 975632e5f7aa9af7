"""Training-data operators: chat formatting, packing, dedup, mixing, counting, media, URL, quality and PII.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
