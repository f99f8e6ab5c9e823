"""Structured Streaming forms of the interval and choice operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Key = Sequence[str]


def sessions(events: DataFrame, key: Key, gap: str, late: str, ts: str = "ts") -> DataFrame:
    """(key, s, e, n): events at most `gap` apart, merged as they come; late ones are taken up to the watermark."""
    df = events.withWatermark(ts, late).groupBy(*key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("e"))
    return df.select(*key, F.col("w.start").alias("s"), "e", "n")


def window_counts(events: DataFrame, key: Key, size: str, late: str, ts: str = "ts") -> DataFrame:
    df = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *key).agg(F.count("*").alias("n"))
    return df.select(F.col("w.start").alias("s"), *key, "n")


def pick_no_repeat(requests: DataFrame, ranked: Sequence[str], no_repeat: int, key: str = "key", order: str = "pos") -> DataFrame:
    """(key, pos, path): for each key's requests in turn the best path not among its last `no_repeat` picks; the picks are
    the key's state, so batches go on where the ones before ended."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for _ in range(len(rows)):
            block = set(last[-no_repeat:]) if no_repeat else set()
            pick = next((n for n in ranked[: no_repeat + 1] if n not in block), None)
            out.append(pick)
            last = (last + [pick])[-no_repeat:] if pick is not None and no_repeat else last
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), "path": out})

    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in (key, order))
    return requests.select(key, order).groupBy(key).applyInPandasWithState(step, f"{kinds}, path string", "last array<string>", "append", GroupStateTimeout.NoTimeout)
