"""Training-data operators: dedup, packing, token output, extraction, scoring, mixing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
