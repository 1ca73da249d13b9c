"""Named queries over the driver's tables (Spark builders and DuckDB texts)."""

from feedlens.catalog.registry import BRUTE, ORACLE, QUERIES  # noqa: F401
from feedlens.catalog import agreement_q  # noqa: F401,E402
from feedlens.catalog import build_q  # noqa: F401,E402
from feedlens.catalog import text_q  # noqa: F401,E402
from feedlens.catalog import training_q  # noqa: F401,E402
from feedlens.catalog import metrics_q  # noqa: F401,E402
from feedlens.catalog import sources_q  # noqa: F401,E402
from feedlens.catalog import extended_q  # noqa: F401,E402
from feedlens.catalog import bertscore_q  # noqa: F401,E402
