"""Links among sets by their rarest items, without comparing all with all.

``p`` percent is the least similarity. Items are ordered by how many sets hold them, rarest
first. Two linked sets share one of their first ``n - ceil(p n / 100) + 1`` items, and the
rarest item that they share is among these; so each pair needs to be looked at only in the
list of that item. Items of one set alone are shared with nobody; they count in
``n`` but are not stored.

A list's *hub* is the set with the least share of items of its own. Against the hub, of
size h, each set of the list lacks ``a`` items and has ``b`` others. Two sets with s lacking
or other items in common are linked if and only if

    cost(x) + cost(y) - (100 + p) s <= (100 - p) h,   cost = 100 a + p b.

Sets linked with the hub are in one component. A set that is not (it is *far*) needs some s to be
linked with another one. s is at most min(a) + min(other), where ``other`` are the other
items after the list's; all hub items before the list's must be lacked (``early``) by one
of the two, as they would else share a rarer one. The list's greatest a - b, ``other`` and
``early`` rule most far sets out; the rest are paired where these bounds hold for both.

Lists are never expanded into their pairs nor cut. Where many far sets of one list pass the bounds,
their pairs are many, as their links are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_MARK = pa.struct([("key", pa.int64()), ("hub_early", pa.int32()), ("early", pa.int32()), ("other", pa.int32())])


def ranked(sets: DataFrame, percent: int) -> DataFrame:
    """(v, n, tokens): items that other sets share too, as (times, item), rarest first; sets that can have links."""
    items = sets.select("v", F.explode("items").alias("item"))
    times = items.groupBy("item").agg(F.count("*").cast("int").alias("times")).where("times > 1")
    tokens = items.join(times, "item").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("tokens"))
    out = sets.select("v", F.size("items").alias("n")).join(tokens, "v")
    first = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1 - (F.col("n") - F.size("tokens"))
    return out.withColumn("first", first.cast("int")).where("first > 0")


def _common(x_times, x_items, h_times, h_items, keys):
    """Number of shared items, and for each key: hub items before it, of these lacking, other items after it."""
    _, at, _ = np.intersect1d(x_items, h_items, assume_unique=True, return_indices=True)
    shared = np.zeros(len(x_items), dtype=bool)
    shared[at] = True
    marks = []
    for time, key in keys:
        before = (h_times < time) | ((h_times == time) & (h_items < key))
        mine = (x_times < time) | ((x_times == time) & (x_items < key))
        after = ~mine & (x_items != key)
        early = int(before.sum())
        marks.append((key, early, early - int((shared & mine).sum()), int((after & ~shared).sum())))
    return len(at), marks


def _against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def array(column, i, name):
        return column[i].values.field(name).to_numpy(zero_copy_only=False)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            common, marks = [], []
            for i in range(part.num_rows):
                x, h, keys = part.column("tokens"), part.column("hub_tokens"), part.column("keys")[i].as_py()
                found = _common(
                    array(x, i, "times"), array(x, i, "item"), array(h, i, "times"), array(h, i, "item"),
                    [(k["times"], k["item"]) for k in keys],
                )
                common.append(found[0])
                marks.append([dict(zip(("key", "hub_early", "early", "other"), m, strict=True)) for m in found[1]])
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("v", "hub", "n", "hub_n")),
                    pa.array(common, pa.int32()),
                    pa.array(marks, pa.list_(_MARK)),
                ],
                names=["v", "hub", "n", "hub_n", "common", "marks"],
            )


def candidates(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``sets`` (v, items) -> links (a, b) with hubs, and the pairs (a, b) that are still open."""
    p = percent
    tokens = materialize(ranked(sets, percent), "ranked")
    own = F.round(1 - F.size("tokens") / F.col("n"), 2)
    entries = tokens.select("v", own.alias("own"), F.explode(F.slice("tokens", F.lit(1), F.col("first"))).alias("token"))
    entries = entries.select(F.col("token.item").alias("key"), "token", "v", "own")
    hubs = entries.groupBy("key").agg(
        F.count("*").alias("m"), F.min(F.struct("own", F.xxhash64("v").alias("h"), "v")).alias("hub")
    )
    stars = entries.join(hubs.where("m > 1").select("key", F.col("hub.v").alias("hub")), "key").where("v <> hub")
    # a set has at most as many keys as items
    stars = stars.groupBy("v", "hub").agg(F.collect_list("token").alias("keys"))
    pairs = stars.join(tokens.select("v", "n", "tokens"), "v").join(
        tokens.select(F.col("v").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens")), "hub"
    )
    kind = tokens.schema["v"].dataType.simpleString()
    met = pairs.select("v", "hub", "n", "hub_n", "keys", "tokens", "hub_tokens").mapInArrow(
        _against_hub,
        f"v {kind}, hub {kind}, n int, hub_n int, common int,"
        " marks array<struct<key: bigint, hub_early: int, early: int, other: int>>",
    )
    linked = 100 * F.col("common") >= p * (F.col("n") + F.col("hub_n") - F.col("common"))
    met = materialize(met.withColumn("linked", linked), "met")
    links = met.where("linked").select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b"))

    lacks, others = F.col("hub_n") - F.col("common"), F.col("n") - F.col("common")
    rows = met.select("v", "n", "linked", lacks.alias("a"), others.alias("b"), "hub_n", F.explode("marks").alias("m"))
    # cost beyond what two sets may have together
    rows = rows.select(
        F.col("m.key").alias("key"), "v", "n", "linked", "a", "b", (100 * F.col("a") + p * F.col("b")).alias("cost"),
        ((100 - p) * F.col("hub_n")).alias("free"), "m.hub_early", "m.early", "m.other",
    )
    most = rows.groupBy("key").agg(
        F.max(F.col("a") - F.col("b")).alias("most_gain"),
        F.max("early").alias("most_early"),
        F.max("other").alias("most_other"),
    )
    able = (F.col("early") + F.col("most_early") >= F.col("hub_early")) & (
        p * F.col("most_gain") + (100 + p) * F.least("other", "most_other") >= F.col("cost") - F.col("free")
    )
    far = rows.where("not linked").join(most, "key").where(able)
    x, y = far.alias("x"), rows.alias("y")
    least, greatest = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    shared = F.least("x.a", "y.a") + F.least("x.other", "y.other")
    both = (
        (F.col("x.v") != F.col("y.v"))
        & (100 * least >= p * greatest)
        & (F.col("x.early") + F.col("y.early") >= F.col("x.hub_early"))
        & (F.col("x.cost") + F.col("y.cost") - (100 + p) * shared <= F.col("x.free"))
    )
    open_ = x.join(y, (F.col("x.key") == F.col("y.key")) & both)
    return links, open_.select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
