"""Own metrics as pandas aggregates, for what SQL cannot express."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidegrid.operators.prefixes import codes


def pandas_metric(fn):
    """Turn ``fn(y, pred) -> float`` over two pandas Series into an aggregate column function.

    A group is handed over as a whole, so group by something bounded such as a fold.
    """

    @F.pandas_udf("double")
    def metric(y: pd.Series, pred: pd.Series) -> float:
        return float(fn(y, pred))

    return metric


def metric_by(df: DataFrame, keys, fn, within, y: str = "y", pred: str = "pred", out: str = "metric") -> DataFrame:
    """(keys, out): ``fn(y, pred) -> float`` of every group of ``keys``, over two pandas Series; NaN is null.

    The groups of one value of ``within``, some of the keys, reach a task together, as handing over a small group costs more than
    its metric. They are held as a whole, so take something bounded such as a series.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(y).cast("double").alias("__y"), F.col(pred).cast("double").alias("__p"))

    def each(rows: pa.Table) -> pa.Table:
        group = codes(rows, keys)
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        pair = [np.split(rows.column(c).to_pandas().to_numpy(np.float64, na_value=np.nan)[order], first[1:]) for c in ("__y", "__p")]
        found = [float(fn(pd.Series(a), pd.Series(b))) for a, b in zip(*pair)]
        return rows.select(keys).take(pa.array(order[first])).append_column(out, pa.array(found, pa.float64(), from_pandas=True))

    return d.groupBy(*within).applyInArrow(each, StructType([*[d.schema[k] for k in keys], StructField(out, DoubleType())]))
