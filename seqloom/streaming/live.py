"""Parts of a live session as plans over (session, offset) rows: frames, rolling buffers, triggers, commits and rollbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = "session long, offset long, frame binary"


def frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """session, offset, samples of the frames that a receiver has written as parquet files, in batch or as they come.

    A frame is a row of little-endian 32-bit floats; bytes beyond the last whole float are an error.
    """
    rows = (spark.readStream if stream else spark.read).schema(FRAMES).parquet(path)
    return rows.select("session", "offset", samples_of()("frame").alias("samples"))


def samples_of():
    """UDF: the samples of a frame; null for null."""

    @F.pandas_udf("array<float>")
    def samples(frames: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else np.frombuffer(f, "<f4") for f in frames], dtype=object)

    return samples


def frame_of():
    """UDF: samples as a frame of little-endian 32-bit floats; null for null."""

    @F.pandas_udf("binary")
    def frame(samples: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else np.asarray(s, "<f4").tobytes() for s in samples], dtype=object)

    return frame


def strided(samples: Column, ratio: float) -> Column:
    """Every ratio-th sample, from the first on: places are rounded down."""
    n = F.ceil(F.size(samples) / F.lit(float(ratio))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(samples, F.floor(i * F.lit(float(ratio))).cast("int")))).otherwise(F.slice(samples, 1, 0))


def rolling_buffer(rows: DataFrame, key: str, order: str, size: str, most: str) -> DataFrame:
    """Adds held: how many of a session's last samples its buffer holds after each chunk of `size` samples, if it is cut to `most` then.

    `most` may change from chunk to chunk; what a smaller one has cut does not come back. With S the samples so far, the buffer
    holds S less the largest cut so far, max(S - most): a running maximum, so no state is needed.
    """
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(size).over(past))
    cut = F.greatest(F.max(F.col("_sum") - F.col(most)).over(past), F.lit(0))
    return rows.withColumn("held", F.col("_sum") - cut).drop("_sum")


def walk(rows: DataFrame, key: str, order: str, columns: list[str], schema: str, start: Callable[[], dict], step: Callable[[dict, tuple], list[tuple]]) -> DataFrame:
    """Walk each session's rows in order with a state: step(state, values of columns) gives the rows to put out, without the key.

    Tasks hold one state and one batch of rows, never a session. Rows without a key are left out; ties in order go by the columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, None
        for b in batches:
            out = []
            for session, *values in b.itertuples(index=False):
                if state is None or session != own:
                    own, state = session, start()
                out += [(session, *row) for row in step(state, values)]
            if out:
                yield pd.DataFrame(out, columns=names)

    names = [key, *[c.split()[0] for c in schema.split(", ")]]
    kind = dict(rows.dtypes)[key]
    sorted_rows = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order, *columns)
    return sorted_rows.select(key, *columns).mapInPandas(run, f"{key} {kind}, {schema}")


def triggers(rows: DataFrame, key: str, order: str, size: str, least: float) -> DataFrame:
    """key, order, cycle, fires: a cycle runs when at least `least` new samples have come since the last one; the count then starts at 0."""

    def step(state: dict, row: tuple) -> list[tuple]:
        at, size = row
        state["new"] += size
        fires, cycle = state["new"] >= least, state["cycle"]
        if fires:
            state.update(new=0, cycle=cycle + 1)
        return [(at, cycle, fires)]

    return walk(rows, key, order, [order, size], f"{order} long, cycle long, fires boolean", lambda: {"new": 0, "cycle": 0}, step)


#: What happens to the last row shown: (kinds of event that may be in the column `what` of ledger)
COMMIT, ADVANCE, PROGRESS, SILENCE, EXIT = "commit", "advance", "progress", "silence", "exit"


def ledger(events: DataFrame, key: str = "session", order: str = "offset") -> DataFrame:
    """key, order, shown, strong, undone: the reference that counts as shown after each event (session, offset, what, ref, strong).

    commit shows a reference on strong or weak evidence. advance shows one that is still pending, and remembers what was shown
    before. progress confirms both. silence takes back a weak commit that no progress has confirmed; exit takes back a pending
    advance. Both give back what was shown before it.
    """

    def step(s: dict, row: tuple) -> list[tuple]:
        at, what, ref, strong = row
        undone = False
        if what in (COMMIT, ADVANCE):
            s["saved"] = (s["shown"], s["before"], s["strong"]) if what == ADVANCE else None
            s.update(before=s["shown"], shown=ref, strong=bool(strong) if what == COMMIT else False, progress=False)
        elif what == PROGRESS:
            s.update(progress=True, saved=None)
        elif what == SILENCE and not s["strong"] and not s["progress"] and s["shown"] is not None:
            s.update(shown=s["before"], strong=False, saved=None)
            undone = True
        elif what == EXIT:
            if s["saved"]:
                s["shown"], s["before"], s["strong"] = s["saved"]
                undone = True
            s.update(saved=None, progress=False)
        return [(at, s["shown"], s["strong"], undone)]

    start = lambda: {"shown": None, "before": None, "strong": False, "progress": False, "saved": None}
    return walk(events, key, order, [order, "what", "ref", "strong"], f"{order} long, shown string, strong boolean, undone boolean", start, step)
