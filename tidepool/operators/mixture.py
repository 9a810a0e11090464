"""The organic share of trades: a mixture of two exponentials over trade sizes, fitted by expectation maximisation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, FEWEST = 200, 4
#: Rates that differ by less than this share are one component, of which the first one's weight counts.
ALIKE = 1e-6
#: Sizes are counted on a fine logarithmic grid first, so a group's input is bounded however many trades it has.
GRID = 400


def fit_share(sizes: np.ndarray, counts: np.ndarray) -> float | None:
    """The weight of the component of smaller mean; None with few or no positive sizes."""
    n = counts.sum()
    mean = (sizes * counts).sum() / n if n else 0.0
    if n < FEWEST or mean <= 0:
        return None
    share, small, large = 0.5, 2 / mean, 2 / (3 * mean)
    for _ in range(ROUNDS):
        a, b = share * small * np.exp(-small * sizes), (1 - share) * large * np.exp(-large * sizes)
        total = a + b
        r = np.divide(a, total, out=np.full(len(sizes), 0.5), where=total > 0)
        own, other = (r * counts).sum(), ((1 - r) * counts).sum()
        own_size, other_size = (r * sizes * counts).sum(), ((1 - r) * sizes * counts).sum()
        share = min(max(own / n, 1e-6), 1 - 1e-6)
        small = own / own_size if own_size > 0 else small
        large = other / other_size if other_size > 0 else large
    return float(share if small >= large * (1 - ALIKE) else 1 - share)


def organic_share(trades: DataFrame, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """The keys, phi_size, trades of (keys, size). Sizes are grouped on a logarithmic grid of GRID steps a factor e with
    their exact means, so what one task fits is bounded and hot pools are pre-aggregated."""
    cell = F.when(F.col("size") > 0, F.floor(F.ln("size") * GRID)).otherwise(F.lit(-(2**40)))
    cells = trades.groupBy(*keys, cell.alias("cell")).agg(F.avg("size").alias("size"), F.count("*").alias("n"))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        share = fit_share(rows["size"].to_numpy(float), rows["n"].to_numpy(float))
        return pd.DataFrame({k: [v] for k, v in zip(keys, key, strict=True)} | {"phi_size": [share], "trades": [int(rows["n"].sum())]})

    names = ", ".join(f"{k} {dict(trades.dtypes)[k]}" for k in keys)
    return cells.groupBy(*keys).applyInPandas(fit, f"{names}, phi_size double, trades long")
