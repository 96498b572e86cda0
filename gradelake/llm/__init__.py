"""Training-data operators: formatting, deduplication, decontamination, packing and text statistics.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
