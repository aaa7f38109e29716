"""Training-data operators: extraction, quality, deduplication, decontamination, packing, formatting.

Each module holds one operator with a general DataFrame interface; ``queries``
registers one thin query per operator. Nothing outside this package imports it.
"""
