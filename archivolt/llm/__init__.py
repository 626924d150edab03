"""Training-data operators: deduplication, scoring, filtering, tokenising, packing.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` refers to it.
"""
