"""sparkseries — many time series at once, on Spark.

Data model: a *long* DataFrame ``(series_id, ts, tiebreak, value)``; see
:mod:`sparkseries.schema`.  Subpackages:

* :mod:`sparkseries.sources`   readers/writers and canonical series from tables
* :mod:`sparkseries.operators` roles, statistics, anomalies, ordering, calendar,
  diagnostics, decomposition, forecasting
* :mod:`sparkseries.functions` column-expression helpers (NaN rules, distributions, JSON-safe encoding)
* :mod:`sparkseries.plans`     composed reports and the registered query catalog
"""

from .schema import LONG_COLUMNS, SEQ, SERIES, TB, TS, VALUE  # noqa: F401
from .session import build_session, ensure_checkpoint_dir  # noqa: F401
