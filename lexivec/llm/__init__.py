"""Training-data operators: tokenising, searching, archiving, cleaning, packing and deduplicating.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries; every operator module keeps a general DataFrame interface.
"""
