"""feedlens: preference-data and annotation analytics expressed as Spark DataFrame plans.

Subpackages
-----------
sources    table loading, fixture views, CSV/Parquet hand-off, response cache tables
functions  column-level helpers (text, prompts, reply parsing, scores, ROUGE-L, encoders)
operators  DataFrame-level operators (indexes, splits, joins, pairing, similarity, metrics)
plans      composite jobs a user calls (training tables, retrieval data, evaluation)
streaming  generation against the response cache, batch and Structured Streaming
catalog    the named queries with their SQL oracle texts
"""

import sys as _sys

try:  # ship Python helpers used inside tasks by value, so executors need no install of this package
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
