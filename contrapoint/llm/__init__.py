"""Training-data operators: tokenisation, scoring, filtering, deduplication, search and packing.

Nothing outside this folder imports it; its queries are listed in ``contrapoint.llm.queries``.
"""
