"""Training-data operators: quality, token counts, chat repair, mixing, similarity join, PII,
packing, decontamination, URL verdicts and media columns.

Nothing outside this subpackage imports it.
"""
