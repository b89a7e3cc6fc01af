"""Training-data operators: licences, quality, decontamination, PII, mixing, dedup, WARC, tokens.

Each module holds one operator with its own general interface; ``queries``
registers one query per operator over the whole test tables. Nothing else in
the library imports this package.
"""
