"""Embedding near-duplicates: collision-counting projections.

Vectors are projected on many random directions. Two unit vectors at distance r collide on a direction if
their projections differ by no more than a window centred on either; that happens with a known
probability, larger for near pairs. Rows are sorted by a projection, and a wide window centred on each row picks the rows after it;
the pairs' collisions over all directions are counted, and pairs that reach a count calibrated for recall at the similarity
limit are verified by cosine in double precision.

One projection's windows hold a fixed share of all rows, so windows over the whole table would bring a share of all
pairs. Therefore rows are dealt first, by the signs of other projections (halves at their median zero), into tables of cells: a
cell holds the rows on the same side of `bits` directions, and the sorted windows are those of its rows. The
number of cells grows with the rows, the number of tables follows from the recall asked for at the limit. A pair
that shares cells of several tables is counted in the first of them alone.

Equal vectors are one row with a multiplicity. Cells over `cell_rows` are dealt out by pairs of chunks. A cell
emits per row its number of links and one edge of a spanning forest, never the pairs. What is shuffled is, for each table, a row's id,
its projections and signs in a byte or a bit each, and the vector in its own type, which verifies pairs where they meet:
a dense cell's pairs are too many to be sent to their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from seqloom.llm.common import join_to_classes, open_id, small_batches, solid_id, stage
from seqloom.llm.components import components
from seqloom.llm.simhash import deal_cells, join_pairs, roots, whole_groups
from seqloom.llm.vectors import cosine, usable

#: Directions that collisions are counted over; windows, in distances at the limit: of a collision, and of the sorted one (missed by 6 in 100,000).
DIRECTIONS, WINDOW, WIDE = 48, 1.5, 4.0
#: Steps of a projection in its one-byte form; windows are widened by the rounding of both ends.
STEP, MOST_STEPS = 14, 63
#: Bits of a cell's name, at most: 2**30 cells hold 10**11 rows.
MOST_BITS = 30


class Plan:
    """Directions, windows, tables and the count to reach, for a similarity limit, recall and number of rows."""

    def __init__(self, size: int, rows: int, least: float = 0.95, miss: float = 1e-5, cell: int = 128, seed: int = 11):
        angle, self.least, self.size = math.acos(least), least, size
        self.bits = min(MOST_BITS, max(1, round(math.log2(max(2.0, rows / cell)))))
        same = (1 - angle / math.pi) ** self.bits
        self.tables = max(1, math.ceil(math.log(miss) / math.log(1 - same)))
        near = math.sqrt(2 - 2 * least)
        self.window, self.wide = (math.ceil(w * near * STEP) + 1 for w in (WINDOW, WIDE))
        hit = math.erf(WINDOW / math.sqrt(2))
        self.count, tail = DIRECTIONS, hit**DIRECTIONS
        while tail < 1 - miss and self.count:  # largest count that near pairs reach but for a share of miss
            self.count -= 1
            tail += math.comb(DIRECTIONS, self.count) * hit**self.count * (1 - hit) ** (DIRECTIONS - self.count)
        rng = np.random.default_rng(seed)
        self.counting = rng.standard_normal((size, DIRECTIONS))
        self.sides = rng.standard_normal((size, self.tables * self.bits))

    def project(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs (rows, tables, bits) and projections (rows, DIRECTIONS) as whole steps."""
        bit = (unit @ self.sides > 0).reshape(len(unit), self.tables, self.bits)
        return bit, np.clip(np.rint(unit @ self.counting * STEP), -MOST_STEPS, MOST_STEPS).astype(np.int8)


def units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def cell_links(rows: pd.DataFrame, plan: Plan, kind: str, tile: int = 256) -> pd.DataFrame:
    """rid, links, parent of the rows of one cell that have links in it: how many vectors they link to, and a root of their forest."""
    n, table = len(rows), int(rows["table"].iloc[0])
    steps = np.frombuffer(b"".join(rows["steps"]), np.int8).reshape(n, -1)
    order = np.argsort(steps[:, table % DIRECTIONS], kind="stable")
    rows, steps = rows.iloc[order], np.ascontiguousarray(steps[order].T)
    place = steps[table % DIRECTIONS].astype(np.int16)
    end = np.searchsorted(place, place + plan.wide, "right")  # the window centred on a row, from the row on
    signs = np.frombuffer(b"".join(rows["signs"]), np.uint8).reshape(n, -1)
    vectors = np.frombuffer(b"".join(rows["vector"]), kind).reshape(n, -1)
    unit, weight, chunk = units(vectors), rows["n"].to_numpy(), rows["chunk"].to_numpy()
    split = rows["lo"].iloc[0] != rows["hi"].iloc[0]
    parent, links = np.arange(n), np.zeros(n, np.int64)
    for a0 in range(0, n, tile):
        a = slice(a0, min(a0 + tile, n))
        for b0 in range(a0, int(end[a].max()), 4 * tile):
            b = slice(b0, min(b0 + 4 * tile, int(end[a].max())))
            own, other = np.arange(a.start, a.stop)[:, None], np.arange(b.start, b.stop)[None, :]
            met = (other > own) & (other < end[a][:, None])
            if split:
                met &= chunk[a][:, None] != chunk[b][None, :]
            count = np.zeros(met.shape, np.uint8)
            for s in steps:
                count += np.abs(s[a][:, None] - s[b][None, :]) <= plan.window
            met &= count >= plan.count
            if not met.any():
                continue
            near = unit[a] @ unit[b].T  # verification; what rounding could decide is computed again, in one order
            met &= near >= plan.least - 1e-9
            i, j = np.nonzero(met)
            sure = near[i, j] >= plan.least + 1e-9
            i, j = i + a.start, j + b.start
            for k in np.flatnonzero(~sure):
                sure[k] = cosine(vectors[i[k] : i[k] + 1].astype(np.float64), vectors[j[k] : j[k] + 1].astype(np.float64))[0] >= plan.least
            i, j = i[sure], j[sure]
            if table:
                fresh = [~same_cell(signs[i[k : k + 50_000]], signs[j[k : k + 50_000]], table, plan.bits) for k in range(0, len(i), 50_000)]
                fresh = np.concatenate(fresh or [np.zeros(0, bool)])
                i, j = i[fresh], j[fresh]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            parent = join_pairs(parent, i, j)
    linked = links > 0
    rid = rows["rid"].to_numpy()
    return pd.DataFrame({"rid": rid[linked], "links": links[linked], "parent": rid[roots(parent)[linked]]})


def same_cell(a: np.ndarray, b: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Whether rows of packed signs agree on all bits of one of the first tables."""
    apart = np.unpackbits(a ^ b, axis=1, count=tables * bits).reshape(len(a), tables, bits)
    return ~apart.any(2).all(1)


def near_duplicates(vectors: DataFrame, least: float = 0.95, miss: float = 1e-5, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    n_links counts the other rows linked directly (cosine of at least `least`), component_id is the
    smallest id reachable over links, itself included, and kept says that it is the row's own. A link at
    the limit is missed with a probability of about 2 * miss, and 6e-5 for the sorted window, closer ones with less. Vectors that are
    null, empty, zero, or hold null or non-finite components, and vectors of different lengths, link with nothing
    (of each other). Rows with equal ids or vectors are rows of their own; null ids keep their rows,
    name no component that has another id, and are not kept. An empty table gives no rows; other
    columns are ignored.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == FloatType() else "<f8"
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), solid_id(F.col(id_col)).alias("vec_id"), usable(F.col(vector_col)).alias("ok"), F.col(vector_col).alias("v"))
    small_batches(vectors.sparkSession)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rid": b["rid"], "vec_id": b["vec_id"], "vector": [np.asarray(v, kind).tobytes() if ok else None for v, ok in zip(b["v"], b["ok"])]})

    rows = stage(rows.mapInPandas(packed, "rid long, vec_id long, vector binary").withColumn("vec_id", open_id(F.col("vec_id"))).withColumn("class", F.sha2("vector", 256)), "vectors")
    classes = stage(rows.where("vector is not null").groupBy("class").agg(F.min("rid").alias("rid"), F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.any_value("vector").alias("vector")), "classes")
    sizes = classes.groupBy((F.octet_length("vector") / int(kind[2])).cast("int").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()
    found = None
    for s in sizes:  # one pass for each vector length; usually one
        own = links_of(classes.where(F.octet_length("vector") == int(kind[2]) * s["size"]), Plan(s["size"], s["n"], least, miss), cell_rows, kind)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stage(found, "links")
    comp = stage(components(found.select(F.col("rid").alias("a"), F.col("parent").alias("b"))), "components")
    degree = found.groupBy("rid").agg(F.sum("links").alias("links"))
    named = classes.select("rid", "class", "n", "least_id").join(degree, "rid", "left").join(comp, F.col("rid") == F.col("node"), "left")
    named = named.select("class", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least_id", F.coalesce("component", "rid").alias("component"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = stage(named.join(names, "component").select("class", "n", "n_links", "component_id"), "named")
    own = join_to_classes(rows.where("vector is not null").drop("vector"), named, "class").withColumn("usable", F.lit(True)).select("vec_id", "n_links", "component_id", "usable")
    none = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("usable"))
    out = own.unionByName(none)
    comp_id = F.when(~F.col("usable"), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))


def links_of(classes: DataFrame, plan: Plan, cell_rows: int, kind: str) -> DataFrame:
    """rid, links, parent for the rows of every cell that have links in it. classes: rid, n, vector."""

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                bit, steps = plan.project(units(np.frombuffer(b"".join(b["vector"]), kind).reshape(len(b), -1)))
                signs = np.packbits(bit.reshape(len(b), -1), axis=1)
                codes = (bit * (1 << np.arange(plan.bits))).sum(-1).astype(np.int32)
                yield b.assign(signs=[x.tobytes() for x in signs], steps=[x.tobytes() for x in steps], code=list(codes))

    rows = classes.select("rid", "n", "vector").mapInPandas(tables, "rid long, n long, vector binary, signs binary, steps binary, code array<int>")
    rows = stage(rows, "projections")
    rows = rows.select("rid", "n", "vector", "signs", "steps", F.posexplode("code").alias("table", "code")).withColumn("bucket", F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(F.col("code").cast("long"))).drop("code")
    rows = deal_cells(rows, "bucket", "rid", cell_rows)
    keys = ["bucket", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, keys):
            cuts = np.flatnonzero((whole[keys].to_numpy()[1:] != whole[keys].to_numpy()[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True):
                if b - a > 1:
                    got = cell_links(whole.iloc[a:b], plan, kind)
                    if len(got):
                        yield got

    return rows.repartition(*keys).sortWithinPartitions(*keys, "rid").mapInPandas(run, "rid long, links long, parent long")
