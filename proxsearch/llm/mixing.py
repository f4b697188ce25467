"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, materialize

#: Most patterns (sets of sources that some document belongs to) that the driver plans for; of them, with others than single sources.
MAX_PATTERNS, MAX_OVERLAPS = 2_000_000, 100_000
#: With more patterns than this, sources on their own are left out of the flow, which gives them the same.
FLOW_PATTERNS = 1000
#: A document of at least this share of its pattern's words is chosen by itself; no pattern has more than 1 / LARGE.
LARGE = 1 / 1000
#: Bits of the seeded key that one step sorts documents by; rows of a pattern that are at last put in order by one task.
BITS, ORDERED = 12, 1 << 16


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Words each source should give: all words shared by weight, at most ``most`` times a source's own.

    Weights repeat over the sources in order of code points, null last. What a source can't give is shared
    among the others by weight, until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free = list(order)
    while free:
        rest = float(sum(sizes.values())) - sum(out.values())
        all_ = sum(weight[x] for x in free)
        share = {s: rest * weight[s] / all_ for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return out | share
        out |= {s: most * sizes[s] for s in above}
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(n: int, edges: Iterable[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) edge of a maximum flow of least cost, by shortest augmenting paths."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in edges:
        for u, v, k, x in ((a, b, c, w), (b, a, 0, -w)):
            out[u].append(len(to))
            to.append(v)
            cap.append(k)
            cost.append(x)
    while True:
        dist, via = [float("inf")] * n, [-1] * n
        dist[source], queue, inside = 0, deque([source]), [False] * n
        while queue:
            u = queue.popleft()
            inside[u] = False
            for e in out[u]:
                if cap[e] > 0 and dist[u] + cost[e] < dist[to[e]]:
                    dist[to[e]], via[to[e]] = dist[u] + cost[e], e
                    if not inside[to[e]]:
                        inside[to[e]] = True
                        queue.append(to[e])
        if via[sink] < 0:
            return [cap[e ^ 1] for e in range(0, len(to), 2)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount


def route(patterns: dict[tuple, int], quota: dict[str | None, float], repeat: int = 3) -> dict[tuple, dict]:
    """Words that each pattern gives each of its sources: quotas met as far as possible, with least repetition.

    The k-th use of a pattern's words costs k - 1 a word, which is convex, so words of overlapping sources
    are repeated only where fresh ones run out. No pattern gives more than ``repeat`` times its words.
    """
    uses: dict[str | None, int] = {}
    for p in patterns:
        for s in p:
            uses[s] = uses.get(s, 0) + 1
    out: dict[tuple, dict] = {}
    if len(patterns) > FLOW_PATTERNS:
        out = {p: {p[0]: min(round(quota[p[0]]), repeat * n)} for p, n in patterns.items() if len(p) == 1 and uses[p[0]] == 1}
    kinds = [p for p in patterns if p not in out]
    names = list(dict.fromkeys(s for p in kinds for s in p))
    at = {s: i for i, s in enumerate(names)}
    source, sink, n = 0, 1, 2 + len(names) + len(kinds)
    edges, inner = [], []
    for i, p in enumerate(kinds):
        edges += [(source, 2 + i, patterns[p], k) for k in range(repeat)]
        for s in p:
            inner.append((p, s, len(edges)))
            edges.append((2 + i, 2 + len(kinds) + at[s], patterns[p] * repeat, 0))
    edges += [(2 + len(kinds) + i, sink, round(quota[s]), 0) for i, s in enumerate(names)]
    flow = min_cost_flow(n, edges, source, sink)
    out |= {p: {} for p in kinds}
    for p, s, e in inner:
        out[p][s] = flow[e]
    return out


_ROW = "pattern string, size long, u long, r long, want double, picked boolean"


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Large documents of one pattern in seeded order, each taken if that brings the sum nearer."""
    pdf = pdf.sort_values(["u", "size", "r"]).reset_index(drop=True)
    got, picked = 0.0, []
    for size, want in zip(pdf["size"], pdf["want"], strict=True):
        picked.append(got + size / 2 <= want)
        got += size if picked[-1] else 0
    return pdf.assign(picked=picked)[[c.split()[0] for c in _ROW.split(", ")]]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _digit(level: int) -> Column:
    """BITS bits of the key (u, v), from the top."""
    return F.shiftrightunsigned(F.shiftleft(F.col("u" if level * BITS < 60 else "v"), level * BITS % 60), 64 - BITS).cast("int")


def _edges(rows: DataFrame, level: int) -> DataFrame:
    """(pattern, edge, before): by sums, the digit at which ``want`` is reached, and the words of those below; none where it isn't."""
    sums = rows.groupBy("pattern", _digit(level).alias("digit")).agg(F.sum("size").alias("s"), F.max("want").alias("want"))
    upto = F.sum("s").over(Window.partitionBy("pattern").orderBy("digit"))
    found = sums.withColumn("upto", upto).where("upto > want").groupBy("pattern").agg(F.min(F.struct(F.col("digit"), (F.col("upto") - F.col("s")).alias("before"))).alias("e"))
    return F.broadcast(materialize(found.select("pattern", F.col("e.digit").alias("edge"), F.col("e.before").alias("before"))))  # a row a pattern


def _plan(rows: DataFrame, weights: Sequence[float], repeat: int) -> DataFrame:
    """``rows`` (pattern, size, u, v, r, which names the row, and others) with source_size, target and times: how often each is taken."""
    spark = rows.sparkSession
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    patterns = {tuple(json.loads(r["pattern"])): r["words"] for r in sums}
    if sum(len(p) > 1 for p in patterns) > MAX_OVERLAPS:
        raise ValueError(f"more than {MAX_OVERLAPS} sets of several sources")
    named = {tuple(json.loads(r["pattern"])): r["pattern"] for r in sums}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, repeat)
    flows = route(patterns, quota, repeat)
    plan = []
    for p, words in patterns.items():
        given = sum(flows[p].values())
        k = given // words if words else 0
        first = p[0] if p else None
        plan.append((named[p], words, int(k), float(given - k * words), sizes.get(first, 0) if p else 0, float(quota[first]) if p else 0.0))
    schema = "pattern string, words long, whole long, rest double, source_size long, target double"
    r = rows.join(F.broadcast(spark.createDataFrame(plan, schema)), "pattern")  # at most MAX_PATTERNS rows
    r = r.withColumn("large", (F.col("size") > 0) & (F.col("size") >= F.col("words") * LARGE))
    big = r.where("large").select("pattern", "size", "u", "r", "rest", "words")
    share = big.groupBy("pattern").agg(F.sum("size").alias("big"))
    big = big.join(share, "pattern").withColumn("want", F.col("rest") * F.col("big") / F.col("words"))
    big = materialize(big.groupBy("pattern").applyInPandas(_greedy, _ROW))
    done = F.broadcast(big.groupBy("pattern").agg(F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0)).alias("done")))
    r = r.join(done, "pattern", "left").withColumn("want", F.col("rest") - F.coalesce("done", F.lit(0)))
    edges, level = _edges(r.where("NOT large"), 0), 0
    r = r.join(edges, "pattern", "left").withColumn("digit", _digit(0))
    # below the edge all are picked, above it none; those at it are split further, until few enough are left to put in order
    known = F.when(F.col("large") | (F.col("digit") == F.col("edge")), F.lit(None)).otherwise(F.col("edge").isNull() | (F.col("digit") < F.col("edge")))
    at = materialize(r.where("NOT large AND digit = edge").select("pattern", "size", "u", "v", "r", (F.col("want") - F.col("before")).alias("want")))
    decided = [big.select("r", "picked")]
    while (at.groupBy("pattern").count().agg(F.max("count")).first()[0] or 0) > ORDERED and level < 9:
        level += 1
        cut = at.join(_edges(at, level), "pattern", "left").withColumn("digit", _digit(level))
        decided.append(materialize(cut.where("edge IS NULL OR digit != edge").select("r", (F.col("edge").isNull() | (F.col("digit") < F.col("edge"))).alias("picked"))))
        at = materialize(cut.where("digit = edge").select("pattern", "size", "u", "v", "r", (F.col("want") - F.col("before")).alias("want")))
    run = F.sum("size").over(Window.partitionBy("pattern").orderBy("u", "v", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    decided.append(at.withColumn("run", run).select("r", (F.col("run") - F.col("size") / 2 <= F.col("want")).alias("picked")))
    told = decided[0]
    for t in decided[1:]:
        told = told.unionByName(t)
    r = r.withColumn("known", known)
    cols = [*rows.columns, "whole", "rest", "source_size", "target"]
    every = r.where("known IS NOT NULL").select(*cols, F.col("known").alias("picked")).unionByName(r.where("known IS NULL").select(*cols).join(told, "r").select(*cols, "picked"))
    times = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("picked") & (F.col("rest") > 0), 1).otherwise(0)).otherwise(0)
    return every.withColumn("times", times.cast("long")).drop("whole", "rest", "picked")


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, carry: bool = False) -> DataFrame:
    """A row of ``docs`` by what _plan needs, in seeded order (u; v among rows alike), with all of its columns if ``carry``."""
    placed, at = by_place(docs, doc_id=id_col, text=text_col, source=source_col)
    several = placed.schema[at["source"]].dataType.typeName() == "array"
    source, text = F.col(at["source"]), F.coalesce(F.col(at["text"]), F.lit(""))
    members = F.array_sort(F.array_distinct(source)) if several else F.array(source)
    # JSON leaves nulls out of no array, so null is a member like others
    pattern = F.to_json(F.coalesce(members, F.array().cast("array<string>"))).alias("pattern")
    doc_id = F.col(at["doc_id"]).cast("long").alias("doc_id")
    kept = [F.struct(*placed.columns).alias("row")] if carry else []
    d = placed.select(doc_id, pattern, word_count(text).alias("size"), F.xxhash64(F.lit(seed), doc_id, text).alias("u"), F.monotonically_increasing_id().alias("r"), *kept)
    return materialize(d.withColumn("v", F.xxhash64("r")))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeat: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, pattern, size, source_size, target, taken.

    ``source_col`` is a source, or an array of them where sources overlap; documents are summed by pattern,
    the set of their sources, and only these sums reach the driver (at most MAX_PATTERNS, MAX_OVERLAPS of several sources; beyond that an error). A flow routes
    words from patterns to the sources' targets; a pattern that gives k times its words and a rest takes
    every document k times, and some once more, chosen by a hash of ``seed``, doc_id and text until the rest is
    met: large ones first, one by one; then the others up to a bucket of the hash found from sums by
    bucket, then a bucket of the next bits within it, until few are left, which are put in order. So no task sees
    more than ORDERED rows of a pattern in order, and a source misses its target by half a document at most,
    commonly a small one.

    source_size and target are those of the source; of an overlapping document's first source. Nulls:
    a null text has size 0, a null source is a source (the last); an empty array of sources takes nothing.
    Documents of size 0 take 0. Rows that repeat are documents of their own, any of which may be taken. Null ids
    are told apart by text. Empty input gives no rows. Other columns are ignored. Reruns agree.
    """
    out = _plan(_rows(docs, seed, id_col, text_col, source_col), weights, repeat)
    return out.select("doc_id", "pattern", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeat: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as mix() takes it: not at all, or up to ``repeat`` times.

    Rows are written once beside their key and not moved again, but for the few whose turn comes by order. Nulls
    and the rest are as in mix(); other columns stay, whatever their names.
    """
    out = _plan(_rows(docs, seed, id_col, text_col, source_col, carry=True), weights, repeat).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*").toDF(*docs.columns)
