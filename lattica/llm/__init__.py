"""Training-data operators: one module per operator, plus ``queries``.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
