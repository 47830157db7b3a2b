"""Training-data operators: packing, chat formatting, deduplication, scoring, extraction, tokenising, sanitising.

Nothing else in the library imports this subpackage. ``registry.queries()`` lists its
driver queries; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
