"""Embedding near-dedup with a forest of random-projection trees; dense groups are kept whole beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialize, pick
from .graph import components, union

#: Vectors that a forest is fitted on, at most; every vector is indexed.
SAMPLE = 1 << 16
TILE = 1024
#: A leaf's number must stay under 2^40.
MOST_LEVELS = 38
SAMPLE_COMPONENTS = 1 << 26
#: Share of pairs at the threshold that a forest may miss, as measured on up to PAIRS such pairs.
MISS, PAIRS = 0.001, 8192
#: Components of the vectors that one task holds of one block of a dense group.
BLOCK = 1 << 20


@dataclass
class Forest:
    """Trees of random splits: node i has children 2i + 1 and 2i + 2; a node without threshold is a leaf.

    Where too few of the sample are left to go on splitting it, the levels below take their thresholds from
    all of the sample in that last node: directions are independent, so medians hardly depend on the side. So
    trees get as deep as the number of vectors asks for, whatever the sample.
    """

    directions: np.ndarray  # tree, level, dimension
    base: int  # levels that are split on the sample
    thresholds: list[np.ndarray]  # by tree: node; then by last node and level below it
    margins: list[np.ndarray]
    below: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def fit(sample: np.ndarray, rows: int, trees: int, leaf: int, spill: float, dims: int, seed: int, least: float) -> Forest:
        """Splits at medians of ``sample``; recursion ends where about ``leaf`` of all ``rows`` vectors are left.

        ``trees`` are grown at least (one, if no split is needed), and more, up to four times as many, until they hold all but
        MISS of pairs at cosine ``least``, measured on pairs made for it. If that isn't enough the leaves become larger.
        """
        n = len(sample)
        rng = np.random.default_rng(seed + 1)
        x = sample[rng.permutation(n)[:PAIRS]]
        u = rng.standard_normal(x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        y = least * x + np.sqrt(1 - least * least) * u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        while True:
            levels = base = 0
            while n and rows >> levels > leaf and levels < MOST_LEVELS:
                levels += 1
                base += n >> base > 32
            if not levels:
                trees = 1
            rng = np.random.default_rng(seed)
            grown, missed = Forest(np.empty((0, max(1, levels), dims)), base, [], [], []), np.full(len(x), levels > 0)
            while len(grown.thresholds) < trees or (missed.sum() > MISS * len(x) and len(grown.thresholds) < 4 * trees):
                tree = Forest._tree(sample, rng.standard_normal((max(1, levels), dims)), base, rows, leaf, spill)
                missed &= ~tree._holds(x, y)
                grown = Forest(np.concatenate((grown.directions, tree.directions)), base, grown.thresholds + tree.thresholds, grown.margins + tree.margins, grown.below + tree.below)
            if missed.sum() <= MISS * len(x):
                return grown
            leaf *= 2

    @staticmethod
    def _tree(sample: np.ndarray, directions: np.ndarray, base: int, rows: int, leaf: int, spill: float) -> Forest:
        th, mg = np.full(2 ** (base + 1) - 1, np.nan), np.zeros(2 ** (base + 1) - 1)
        under = np.full((2 ** (base + 1) - 1, len(directions) - base), np.nan), np.zeros((2 ** (base + 1) - 1, len(directions) - base))
        held = {0: np.arange(len(sample))}
        projected = sample @ directions[:, : sample.shape[1]].T
        for level in range(base + 1):
            below = {}
            for node, members in held.items():
                p = projected[members]
                width = p[:, level].std() if len(p) and level < len(directions) else 0.0
                if level < base and len(p) > 32 and width >= 1e-9:
                    th[node], mg[node] = np.median(p[:, level]), spill * width
                    below[2 * node + 1] = members[p[:, level] < th[node] + mg[node]]
                    below[2 * node + 2] = members[p[:, level] >= th[node] - mg[node]]
                    continue
                more = int(np.ceil(np.log2(max(1.0, len(p) * rows / max(1, len(sample)) / leaf))))
                if len(p) >= 8 and width >= 1e-9 and level == base:
                    at = slice(0, min(more, len(directions) - base))
                    under[0][node, at] = np.median(p[:, base:], axis=0)[at]
                    under[1][node, at] = spill * p[:, base:].std(0)[at]
            held = below
        return Forest(directions[None], base, [th], [mg], [under])

    def _holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether any leaf holds both x[i] and y[i], of a forest of one tree."""
        (r, _, a), (q, _, b) = self.route(x), self.route(y)
        both = np.zeros(len(x), bool)
        both[r[np.isin(r << 40 | a, q << 40 | b)]] = True
        return both

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, leaf) of every leaf that each row of ``x`` falls into; near a threshold, into both sides."""
        out = []
        for t, (th, mg, under) in enumerate(zip(self.thresholds, self.margins, self.below, strict=True)):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            last = node  # the last node that was split on the sample, or wasn't
            proj = x @ self.directions[t, :, : x.shape[1]].T
            for level in range(self.directions.shape[1]):
                split, margin = (th[node], mg[node]) if level < self.base else (under[0][last, level - self.base], under[1][last, level - self.base]) if under[0].shape[1] else (np.full(len(row), np.nan), 0.0)
                inner = ~np.isnan(split)
                if not inner.any():
                    if level < self.base:
                        continue
                    break
                p = proj[row, level]
                left, right = inner & (p < split + margin), inner & (p >= split - margin)
                row, node, last = (np.concatenate((v[~inner], v[left], w[right])) for v, w in ((row, row), (2 * node + 1, 2 * node + 2), (last, last)))
                n_stay = int((~inner).sum())
                node[:n_stay] = (node[:n_stay] - 1) // 2
                if level < self.base:
                    last = node
            out.append((row, np.full(len(row), t), node))
        row, tree, node = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((node, tree, row))
        return row[order], tree[order], node[order]


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as unit vectors in double precision, however large or small their components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.maximum(np.abs(flat).max(1, keepdims=True, initial=0), 5e-324)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def code_table(column: pa.ChunkedArray, tree: int) -> np.ndarray:
    """(row, tree, slot): the leaves of each row in the trees up to ``tree``; -1 where there are no more."""
    lists = column.combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_numpy()])
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    keep = flat >> 40 <= tree
    row, t, leaf = row[keep], flat[keep] >> 40, flat[keep] & ((1 << 40) - 1)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (t[1:] != t[:-1])))
    starts = np.flatnonzero(new)
    slot = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    out = np.full((len(lists), tree + 1, int(slot.max()) + 1), -1, np.int64)
    out[row, t, slot] = leaf
    return out


def leaf_links(x: np.ndarray, copies: np.ndarray, codes: np.ndarray, tree: int, node: int, least: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within one leaf: for each vector the linked others (with their copies) that no earlier leaf
    also holds with it, and the root of its links within the leaf.

    ``codes`` (row, tree, slot; -1 none) are all leaves of each vector, so a pair counts in the first leaf
    that both are in, whatever number of leaves finds it. Pairs are made tile by tile and never leave.
    ``side``: only pairs of one vector of either side count, where a leaf comes as pairs of its blocks.
    """
    n = len(x)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    ups, downs = (np.arange(n),) * 2 if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    for i0 in range(0, len(ups), TILE):
        for j0 in range(i0 if side is None else 0, len(downs), TILE):
            up, down = ups[i0 : i0 + TILE], downs[j0 : j0 + TILE]
            i, j = np.nonzero(x[up] @ x[down].T >= least)
            i, j = up[i], down[j]
            if side is None:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            parent = union(i, j, parent)
            first = np.ones(len(i), bool)
            for t in range(tree + 1):
                for s in range(codes.shape[2]):
                    c = codes[i, t, s]
                    known = (c >= 0) & ((c < node) if t == tree else True)
                    if known.any():
                        first &= ~(known & (codes[j, t] == c[:, None]).any(1))
            np.add.at(links, i[first], copies[j[first]])
            np.add.at(links, j[first], copies[i[first]])
    return links, parent


@dataclass
class Balls:
    """Centres of dense groups. A vector within twice the linking angle of a centre is a core vector of the
    nearest one. Whatever links with it is within three times that angle, so comparing the cores with all
    vectors within that (the halo) finds every link of a core vector."""

    centres: np.ndarray
    core: float  # least cosines
    halo: float
    blocks: np.ndarray  # by centre

    @staticmethod
    def fit(sample: np.ndarray, rows: int, leaf: int, least: float, seed: int) -> Balls:
        """Centres such that vectors linked with an eighth of a leaf, by ``sample``, are core vectors."""
        n, angle = len(sample), float(np.arccos(np.clip(least, -1, 1)))
        out = Balls(np.empty((0, sample.shape[1])), float(np.cos(min(np.pi, 2 * angle))), float(np.cos(min(np.pi, 3 * angle))) - 1e-6, np.empty(0, np.int64))
        if rows <= leaf or not n:
            return out
        need = max(8.0, leaf / 8 * n / rows)
        some = np.random.default_rng(seed).permutation(n)[: int(np.ceil(32 * n / need))]
        single, counts = sample.astype(np.float32), np.zeros(len(some), np.int64)
        for i in range(0, len(some), TILE):
            for j in range(0, n, 4 * TILE):
                counts[i : i + TILE] += (single[some[i : i + TILE]] @ single[j : j + 4 * TILE].T >= least).sum(1)
        order = np.argsort(-counts, kind="stable")
        left, found = some[order][counts[order] >= need], []
        while len(left):
            found.append(left[0])
            left = left[1:][sample[left[1:]] @ sample[left[0]] < least]
        out.centres = sample[found]
        near = np.zeros(len(found), np.int64)
        for i in range(0, n, TILE):
            near += (sample[i : i + TILE] @ out.centres.T >= out.halo).sum(0)
        out.blocks = np.ceil(near * (rows / n) / max(TILE, BLOCK // sample.shape[1])).astype(np.int64).clip(1)
        return out

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centre of each core vector (others: the number of centres), and the cosines to all centres."""
        none = len(self.centres)
        cos = x @ self.centres[:, : x.shape[1]].T
        if not none:
            return np.zeros(len(x), np.int64), cos
        best = cos.argmax(1)
        return np.where(cos[np.arange(len(x)), best] >= self.core, best, none), cos

    def tiles(self, ids: np.ndarray, home: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, centre, tile, block, core) of every pair of blocks that each vector is compared in. A core vector is
        in the halo of the centres before its own only, so that a pair of cores is compared once."""
        none = len(self.centres)
        at = np.arange(none)
        row, centre = np.nonzero((at < home[:, None]) & (cos >= self.halo) | (at == home[:, None]))
        blocks = self.blocks[centre]
        block = ((ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(row)), blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        own = block[again]
        return row[again], centre[again], np.minimum(own, other) << 20 | np.maximum(own, other), own, (centre == home[row])[again]


def dense_links(x: np.ndarray, copies: np.ndarray, block: np.ndarray, core: np.ndarray, tile: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """As leaf_links, for a pair of blocks (or one with itself) of a dense group: links of which one end is a core vector."""
    links, parent, weight = np.zeros(len(x), np.int64), np.arange(len(x)), copies.astype(np.float64)
    b0, b1 = tile >> 20, tile & ((1 << 20) - 1)
    left, right = (r[np.argsort(~core[r], kind="stable")] for r in (np.flatnonzero(block == b) for b in (b0, b1)))
    for i0 in range(0, len(left), TILE):
        for j0 in range(i0 if b0 == b1 else 0, len(right), TILE):
            i, j = left[i0 : i0 + TILE], right[j0 : j0 + TILE]
            if not (core[i[0]] or core[j[0]]):
                continue
            hit = (x[i] @ x[j].T >= least) & (core[i][:, None] | core[j])
            if b0 == b1 and i0 == j0:
                hit = np.triu(hit, 1)
            if not hit.any():
                continue
            h = hit.astype(np.float64)
            links[i] += np.rint(h @ weight[j]).astype(np.int64)
            links[j] += np.rint(weight[i] @ h).astype(np.int64)
            r, c = hit.any(1), hit.any(0)
            parent = union(np.concatenate((i[r], i[hit.argmax(0)][c])), np.concatenate((j[hit.argmax(1)][r], j[c])), parent)
            r, c = np.nonzero(hit & (parent[i][:, None] != parent[j]))
            parent = union(i[r], j[c], parent)
    return links, parent


_LEAF = "tree int, node long, label int, dims int, x long, copies long, vector array<double>, codes array<long>"


def _rows(own: pa.RecordBatch, row: np.ndarray, tree: np.ndarray, node: np.ndarray, codes: Callable[[np.ndarray], list]) -> Iterator[pa.RecordBatch]:
    """The rows ``row`` of ``own`` as batches of _LEAF."""
    if not len(row):
        return
    for at in np.array_split(np.arange(len(row)), max(1, len(row) // 4000)):
        taken = own.take(pa.array(row[at]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree[at].astype(np.int32)), pa.array(node[at]), taken.column("label"), taken.column("dims"), taken.column("x"), taken.column("copies"), taken.column("vector"), pa.array(codes(at), pa.list_(pa.int64()))],
            names=[c.split()[0] for c in _LEAF.split(", ")],
        )


def embedding_dedup(
    vectors: DataFrame, least: float = 0.93, trees: int = 8, leaf: int = 2048, spill: float = 0.1, sample: int = SAMPLE, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least
    ``least``. Equal vectors are one class, of which one is compared. A forest is fitted on at most
    ``sample`` classes (fewer, if they are long) and broadcast (``trees`` * ``sample`` / 4 thresholds at most); every class goes to its
    leaves in every tree, with spill over thresholds it is near to. Within a leaf all pairs are compared by
    matrix products, tile by tile; a task returns counts and the links of a spanning forest. A leaf that came
    out larger than BLOCK components is compared as pairs of blocks, so no task holds more than two.
    A pair that no leaf holds is missed; trees are added until that is so of at most MISS of pairs at the threshold.

    Dense groups, which thresholds would cut at most levels, don't enter the forest: classes linked with an eighth
    of a leaf or more (by the sample) are compared around centres instead, block by block, and lose no link.

    Nulls: vectors that are null, zero or hold null or non-finite components link with nothing, and so
    do those without label or vec_id (component_id is then vec_id, kept true). Vectors of different
    lengths never link. Repeated rows are vectors of their own; rows that share a vec_id are one node.
    Empty input gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    d = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vector", lambda v: v != 0)
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & some, F.lit(False))
    keys = [F.xxhash64(F.lit(k), "label", F.size("vector"), "vector").alias(f"k{k}") for k in (1, 2)]
    rows = d.select("vec_id", "label", "vector", fit.alias("fit"), *keys)
    good = rows.where("fit")
    key = ["k1", "k2"]
    # equal vectors by two hashes of theirs
    classes = good.groupBy(*key).agg(F.min("vec_id").alias("x"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialize(classes)
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims"), F.sum("copies").alias("rows")).first()
    n, dims, total = stats["n"], stats["dims"] or 1, stats["rows"] or 0
    sample = max(1024, min(sample, SAMPLE_COMPONENTS // dims))
    part = classes.where(F.pmod(F.xxhash64("k1", F.lit(seed)), F.lit(1_000_000_000)) < int(1e9 * min(1.0, 0.9 * sample / max(1, n)) + (n <= sample) * 1e9))
    # vectors of another length than the longest are routed by the same directions, cut
    drawn = (part if n > leaf else part.limit(0)).select("vector").limit(sample).toArrow()["vector"].combine_chunks()
    sizes = drawn.value_lengths().to_numpy()
    points = np.zeros((len(drawn), dims))
    points[np.arange(dims) < sizes[:, None]] = drawn.flatten().to_numpy(zero_copy_only=False)
    points /= np.maximum(np.abs(points).max(1, keepdims=True, initial=0), 5e-324)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    balls = Balls.fit(points, n, leaf, least, seed)
    rest = points[balls.homes(points)[0] == len(balls.centres)]
    sent = spark.sparkContext.broadcast((Forest.fit(rest, n * len(rest) // max(1, len(points)), trees, leaf, spill, dims, seed, least), balls))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, balls = sent.value
        for b in batches:
            sizes = b.column("dims").to_numpy()
            for size in np.unique(sizes):
                own = b.filter(pa.array(sizes == size))
                x = unit(own.column("vector"))
                home, cos = balls.homes(x)
                out = np.flatnonzero(home == len(balls.centres))
                row, tree, node = forest.route(x[out])
                # codes of a row: for each leaf, tree * 2^40 + node
                code = tree.astype(np.int64) << 40 | node
                cuts = np.searchsorted(row, np.arange(len(out) + 1))
                codes = [code[cuts[r] : cuts[r + 1]] for r in range(len(out))]
                yield from _rows(own, out[row], tree, node, lambda at, row=row, codes=codes: [codes[r] for r in row[at].tolist()])
                # in a dense group: its block there, and whether it is a core vector
                row, centre, tile, block, core = balls.tiles(own.column("x").to_numpy(), home, cos)
                yield from _rows(own, row, -1 - centre, tile, lambda at, block=block, core=core: np.stack((block[at], core[at]), 1).tolist())

    def found_in(x: np.ndarray, links: np.ndarray, parent: np.ndarray) -> pa.Table:
        some = np.flatnonzero((links > 0) | (parent != np.arange(len(x))))
        return pa.table({"x": x[some], "root": x[parent[some]], "links": links[some]})

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in route([b]):
                t = pa.Table.from_batches([r.select(keys4)]).group_by(keys4).aggregate([([], "count_all")])
                yield from t.rename_columns([*keys4, "n"]).combine_chunks().to_batches()

    def compare(table: pa.Table) -> pa.Table:
        x, copies, tree, node, tile = table["x"].to_numpy(), table["copies"].to_numpy(), table["tree"][0].as_py(), table["node"][0].as_py(), table["tile"][0].as_py()
        order = np.argsort(x, kind="stable")
        if tree < 0:
            marks = table["codes"].combine_chunks().flatten().to_numpy().reshape(-1, 2)
            links, parent = dense_links(unit(table["vector"].combine_chunks())[order], copies[order], marks[order, 0], marks[order, 1] > 0, node, least)
        else:
            side = None if tile >> 20 == tile & ((1 << 20) - 1) else table["own"].to_numpy()[order] == tile & ((1 << 20) - 1)
            links, parent = leaf_links(unit(table["vector"].combine_chunks())[order], copies[order], code_table(table["codes"], tree)[order], tree, node, least, side)
        return found_in(x[order], links, parent)

    keys4 = ["tree", "node", "label", "dims"]
    given = classes.select("x", "copies", "label", F.size("vector").alias("dims"), "vector")
    counts = given.mapInArrow(sizes_of, "tree int, node long, label int, dims int, n long").where("tree >= 0").groupBy(*keys4).agg(F.sum("n").alias("n"))
    counts = counts.withColumn("blocks", F.ceil(F.col("n") / F.greatest(F.lit(TILE), F.lit(BLOCK) / F.col("dims"))))
    large = materialize(counts.where("blocks > 1"))
    routed = given.mapInArrow(route, _LEAF)
    if large.limit(1).count():
        cut = join_unique(routed, large, keys4, "n", counts.agg(F.sum("n")).first()[0], "left")
        own = F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("x"), F.col("blocks"))).otherwise(F.lit(0).cast("long"))
        cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)))
        tile = F.shiftleft(F.least("own", "other"), 20).bitwiseOR(F.greatest("own", "other"))
        routed = cut.withColumn("tile", tile).drop("n", "blocks", "other")
    else:
        routed = routed.withColumns({"own": F.lit(0).cast("long"), "tile": F.lit(0).cast("long")})
    found = materialize(routed.groupBy(*keys4, "tile").applyInArrow(compare, "x long, root long, links long"))
    degree = found.groupBy("x").agg(F.sum("links").alias("links"))
    edges = found.where("x != root").select(F.col("x").alias("a"), F.col("root").alias("b"))
    twice = good.groupBy("vec_id").agg((F.min("k1") != F.max("k1")).alias("several")).where("several").select("vec_id")
    same_id = good.join(twice, "vec_id", "left_semi").select("vec_id", *key).join(classes.select(*key, "x"), key).where("vec_id != x")
    comps = components(edges.unionByName(same_id.select(F.col("vec_id").alias("a"), F.col("x").alias("b"))))
    named = classes.select(*key, "x", "copies").join(degree, "x", "left").join(comps.withColumnRenamed("node", "x"), "x", "left")
    named = named.select(*key, "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "x").alias("component_id"))
    linked = join_unique(good.select("vec_id", *key), named, key, "copies", total, "inner").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
