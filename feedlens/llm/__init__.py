"""Training-data operators: quality voting, repeated passages, chat format, shards, near
duplicates, exact search, mixing, rule outliers, WARC archives and packing.

Each module holds one operator with its general interface; ``queries`` registers the thin
``opN_*`` queries over the driver's tables.
"""
