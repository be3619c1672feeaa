"""Explicit schemas of the input tables; nothing is inferred."""

from pyspark.sql import types as T

from panelgrid.functions.constants import VARIABLE_SETS

_D, _S, _I, _L = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


FEATURES = list(dict.fromkeys(c for cols in VARIABLE_SETS.values() for c in cols
                              if c not in ("MODIS_LC", "year")))

METRIC_NAMES = ["r2_overall", "r2_trend", "r2_anomalies", "r2_sites", "r2_msc", "rmse_overall",
                "rmse_trend", "rmse_anomalies", "rmse_sites", "rmse_msc"]
METRICS = _struct(("exp_id", _S), *[(m, _D) for m in METRIC_NAMES])
PREDICTIONS = _struct(("exp_id", _S), ("rep", _I), ("fold", _I), ("site", _S),
                      ("date", T.DateType()), ("y", _D), ("y_pred", _D))
FOLDS = _struct(("exp_id", _S), ("rep", _I), ("fold", _I), ("site", _S), ("role", _S))
RUNS = _struct(("exp_id", _S), ("rep", _I), ("started", T.TimestampType()), ("seconds", _D),
               ("params", _S))
SEARCH = _struct(("rep", _I), ("fold", _I), ("algorithm", _S), ("preprocessor", _S),
                 ("score", _D), ("status", _S))
LEARNING_CURVE = _struct(("rep", _I), ("fold", _I), ("ts", T.TimestampType()),
                         ("ensemble_optimization_score", _D))
