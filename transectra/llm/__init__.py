"""Training-data operators: quality, language, duplicates, secrets, tokens, packing, URL lists.

Each module holds one operator with its own interface; :mod:`.queries` registers
the thin ``opN_<name>`` queries. Nothing else in the library imports this package.
"""
