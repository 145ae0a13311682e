"""Training-data operators: packing, tokenisation, media, extraction, scoring and deduplication.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it can be removed as a whole.
"""
