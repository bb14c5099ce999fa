"""A Bloom filter of ids of fixed size, to thin a scan before its join with few ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^24 bits: 2 MB, however many ids there are. More ids let more other rows through, lose none.
BITS = 24


def only(rows: DataFrame, id_col: str, ids: DataFrame, of: str) -> DataFrame:
    """rows whose id may be one of ids: all that are, and few others. At most 2^18 words of bits
    reach the driver, from where the filter is broadcast."""
    place = F.pmod(F.xxhash64(F.col(of).cast("long")), F.lit(1 << BITS))
    words = ids.select(place.alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    found = words.toPandas()
    table = np.zeros((1 << BITS) // 64, np.int64)
    table[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def test(p: pd.Series) -> pd.Series:
        p = p.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 6] >> (p & 63)) & 1 == 1)

    return rows.filter(F.pandas_udf(test, "boolean")(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << BITS))))
