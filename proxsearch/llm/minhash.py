"""MinHash near-dedup by fast similarity sketches, banding and verification on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_unique, key_filter, materialize, may_pass, partitions, pick
from .graph import components
from .words import Words, grams, mix, words

_U = np.uint64
#: Members of one centre that a task compares; sets that each is compared with in the first round, the centre's among them, and at last.
STAR, SETS, MOST_SETS = 1000, 512, 2048
#: Members, of all centres, for which a round takes one more task, up to the session's number.
TASK = 64
#: Shingles of all these sets that a task holds (64 MB); of long texts fewer sets fit, and the rest are members like others.
SET_ITEMS = 1 << 22


def shingles(hashes: np.ndarray, n: int, stream: int = 0) -> np.ndarray:
    """Hashes of the ``n``-word shingles, in order of the text; of all words at once if there are fewer."""
    if not len(hashes):
        return hashes
    return grams(hashes, min(n, len(hashes)), 11 if len(hashes) >= n else 12, stream)


class Sketcher:
    """Fast similarity sketching: in round i < t every element falls into a hashed one of ``t`` bins, in
    round t + j into bin j. A bin keeps the least (round, value) it gets, so it is full after 2t rounds at
    most, in practice after a few; two sets agree in a bin with probability of their Jaccard similarity."""

    def __init__(self, t: int, seed: int = 7):
        if not 0 < t <= 256:
            raise ValueError("a sketch has 1 to 256 bins")
        self.t = t
        self.seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))

    def __call__(self, items: np.ndarray) -> np.ndarray:
        t, n = self.t, len(items)
        out = np.full(t, _U(0xFFFFFFFFFFFFFFFF))
        done = 0
        while done < t:
            rounds = min(t - done, max(1, -(-3 * t // n)))
            h = mix(items[None, :] ^ self.seeds[done : done + rounds, None])
            bins = ((h >> _U(44)) * _U(t)) >> _U(20)
            at = np.arange(done, done + rounds, dtype=np.uint64)[:, None]
            keys = (bins << _U(53) | at << _U(44) | h & _U((1 << 44) - 1)).ravel()
            keys.sort()
            bins = (keys >> _U(53)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
            at_bins = bins[first]
            out[at_bins] = np.minimum(out[at_bins], keys[first] & _U((1 << 53) - 1))
            done += rounds
            if out.max() < _U(1 << 53):
                return out
        for j in np.flatnonzero(out >= _U(1 << 53)).tolist():
            out[j] = _U((t + j) << 44) | (mix(items ^ self.seeds[t + j]) & _U((1 << 44) - 1)).min()
        return out


def _sketches(n_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(bands * rows)
        power = mix(np.arange(1, rows + 1, dtype=np.uint64)) | _U(1)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) + _U(1 << 40))
        none = np.zeros(bands, np.int64)
        for b in batches:
            n, names, flat = [], [], []
            for chunk in words(b.column("text"), fold=True):
                for i in range(len(chunk)):
                    items, at = np.unique(shingles(chunk.of(i), n_words), return_index=True)
                    n.append(len(items))
                    # two independent hashes of each shingle name the set
                    other = shingles(chunk.second[chunk.first[i] : chunk.first[i + 1]], n_words, 1)[at]
                    names.append(hashlib.blake2b(items.tobytes() + other.tobytes(), digest_size=16).digest())
                    if not len(items):
                        flat.append(none)
                        continue
                    flat.append(mix((sketch(items).reshape(bands, rows) * power).sum(1) ^ salt).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(n) + 1, bands), pa.int32()), pa.array(np.concatenate(flat) if flat else none[:0]))
            s = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), lists], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def prefixes(items: np.ndarray, known: np.ndarray, centre: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the buckets in which a set meets every set that it can be linked with, of those compared with ``centre``.

    In any one order of shingles, two sets that are alike enough share one among the first few of each: of
    a set of n, the first n - 2tn / (1 + t) + 1 suffice to meet larger ones, and n - tn + 1 to meet
    smaller ones (t = percent / 100). The order here goes by ``known``, in how many of the sets around the centre a
    shingle is: in a family with much in common, what few of its members have comes first. Returns the
    former and the rest of the latter.
    """
    n = len(items)
    few, most = n + 1 - -(-2 * percent * n // (100 + percent)), n + 1 - -(-percent * n // 100)
    order = items[np.argsort(known, kind="stable")][:most]
    names = mix(order ^ mix(np.array([centre], np.int64).view(np.uint64), 1), 1).view(np.int64)
    return names[:few], names[few:]


class Around:
    """The sets around a centre as inverted lists of differences. ``texts``: (set, shingles, ascending), those of a set together.

    Of the texts the one nearest to all is the reference, and a text is what it has beside it and what it lacks
    of it: its differences. Two texts differ in just those differences that only one of them has. Near copies have few, most
    of them rare, so a member is held against every text by looking up its own differences in lists of who has
    them. Where the texts are unlike, the reference is empty, and all shingles are differences.
    """

    #: Entries of the lists read at once (some MB), however long the texts are.
    HITS = 1 << 18

    def __init__(self, texts: list[tuple[int, np.ndarray]]):
        self.of = np.array([s for s, _ in texts], np.int64)
        self.size = np.array([len(items) for _, items in texts], np.int64)
        items = np.concatenate([items for _, items in texts])
        order = np.argsort(items, kind="stable")
        items = items[order]
        text = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)[order]
        del order
        new = np.concatenate(([True], items[1:] != items[:-1]))
        first, which = np.flatnonzero(new), (np.cumsum(new) - 1).astype(np.int32)
        self.items = items[first]
        # texts of one set count as one
        owner = self.of[text]
        new[1:] |= owner[1:] != owner[:-1]
        self.sets = np.add.reduceat(new, first, dtype=np.int32)
        self.n_sets = len(np.unique(self.of))
        del owner, new
        # the sum of a text's differences from all, less the same for every text; below 0 there are fewer than shingles
        have = np.diff(np.append(first, len(items)))
        cost = len(texts) * self.size - 2 * np.bincount(text, have[which], len(texts)).astype(np.int64)
        self.reference = int(cost.argmin()) if cost.min() < 0 else None
        within = np.zeros(len(self.items), bool)
        if self.reference is not None:
            within[which[text == self.reference]] = True
        #: The reference's shingles among ``items``, and the place there of each.
        self.own = np.flatnonzero(within)
        self.place = np.where(within, np.cumsum(within, dtype=np.int32) - 1, -1).astype(np.int32)
        there = within[which]
        lacks = np.ones((len(self.own), len(texts)), bool)  # below twice the number of all shingles
        lacks[self.place[which[there]], text[there]] = False
        at, who = np.nonzero(lacks)
        del lacks
        which, text = np.concatenate((which[~there], self.own[at].astype(np.int32))), np.concatenate((text[~there], who.astype(np.int32)))
        self.text = text[np.argsort(which, kind="stable")]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(self.items))))).astype(np.int32)
        self.apart = np.bincount(self.text, minlength=len(texts))

    def _find(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where ``items`` (ascending) are or would be; which are there; which the reference lacks; where those that it has beside them are."""
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        there = self.items[at] == items
        common = there & (self.place[at] >= 0)
        lacking = np.ones(len(self.own), bool)
        lacking[self.place[at[common]]] = False
        return at, there, ~common, self.own[lacking]

    def shared(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of ``items``, ascending, each text has; in how many sets each item is."""
        at, there, beside, lacking = self._find(items)
        known = np.where(there, self.sets[at], 0)
        differs = int(beside.sum()) + len(lacking) + self.apart
        at = np.concatenate((at[there & beside], lacking))
        first, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        total, alike, i = np.cumsum(n), np.zeros(len(self.of), np.int64), 0
        while i < len(at):
            done = int(total[i - 1]) if i else 0
            to = max(i + 1, int(np.searchsorted(total, done + self.HITS, "right")))
            spots = np.repeat(first[i:to] - (total[i:to] - n[i:to]), n[i:to]) + np.arange(done, total[to - 1])
            alike += np.bincount(self.text[spots], minlength=len(alike))
            i = to
        return (len(items) + self.size - (differs - 2 * alike)) // 2, known

    def buckets(self, items: np.ndarray, linked: bool, centre: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """As prefixes(), by differences from the reference; ``linked``: whether this set is linked with it.

        Sets x and y with differences X and Y are linked if |X| + |Y| - 2 |X and Y| <= q (|x| + |y|), q = (1 - t) / (1 + t),
        so they share at least (e(x) + e(y)) / 2 differences, e(x) = |X| - q |x|. Sets linked with the reference, whose e is
        at most q |reference|, are of one component. So they need not meet each other but others, of larger e, who
        share at least one difference with them; others meet each other in buckets of their own. Of a set that has to
        share o, the first |X| - o + 1 suffice, in any one order, here from those that are rare around the centre.
        """
        at, there, beside, lacking = self._find(items)
        found = np.concatenate((items[beside], self.items[lacking]))
        # in how many sets each differs from the reference
        rare = np.concatenate((np.where(there, self.sets[at], 0)[beside], self.n_sets - self.sets[lacking]))
        order = found[np.lexsort((found, rare))]
        n, d, r, p, q = len(items), len(order), int(self.size[self.reference]), 100 + percent, 100 - percent
        e = p * d - q * n
        first = lambda num, den: order[: max(0, d + 1 - max(1, -(-num // den)))]
        name = lambda x, kind: mix(x ^ mix(np.array([centre], np.int64).view(np.uint64), kind), 1).view(np.int64)
        if linked:
            return name(first(e + q * r, 2 * p), 0), np.zeros(0, np.int64)
        few, most = first(e, p), first(e + q * r, 2 * p)
        # a linked one that shares o differences has o at least, and at most n / t shingles
        least, largest = percent * e - q * 100 * n, q * (100 * n + percent * r)
        some = first(least, p * percent) if least <= largest else order[:0]
        return name(few, 1), np.concatenate((name(most[len(few) :], 1), name(some, 0)))


_TESTED = "c long, x long, both long, all_ long, links array<long>, joins array<long>, near array<long>, far array<long>"


def _compare(n_words: int, percent: int):
    """Rows sorted by (c, salt, x, s), the sets around a centre (s, x null) first, its own before the others: each member's Jaccard counts with the
    centre, which of the sets it links with, as many of these links as make the same components, and, unless it is one of the sets, prefixes().

    Sets are compared by one hash of their shingles; what would be a link must be one by another, independent hash too.
    """

    def other(chunk: Words, i: int) -> np.ndarray:
        return np.unique(shingles(chunk.second[chunk.first[i] : chunk.first[i + 1]], n_words, 1))

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, texts, left_out, held, around, none = None, [], set(), 0, None, np.zeros(0, np.int64)
        for b in batches:
            out: list[tuple] = []
            key = list(zip(b.column("c").to_pylist(), b.column("salt").to_pylist(), strict=True))
            member, own = b.column("x").to_pylist(), b.column("s").to_pylist()
            for chunk in words(b.column("text"), fold=True):
                for i in range(len(chunk)):
                    k, x = key[chunk.row + i], member[chunk.row + i]
                    items = np.unique(shingles(chunk.of(i), n_words))
                    if k != centre:
                        centre, texts, left_out, held, around = k, [], set(), 0, None
                    if not len(items):
                        continue
                    if x is None:
                        s = own[chunk.row + i]
                        held += len(items)
                        if s != k[0] and (held > SET_ITEMS or s in left_out):
                            left_out.add(s)
                        else:
                            texts.append((s, items, other(chunk, i)))
                        continue
                    if around is None:
                        texts = [t for t in texts if t[0] not in left_out]
                        around = [Around([(s, one[j]) for s, *one in texts]) for j in (0, 1)] if texts else []
                        # sets already joined by members have the same root
                        root, texts = {s: s for s, *_ in texts}, []
                    links, joins, best, known, linked = none, none, (0, 1), np.zeros(len(items), np.int64), False
                    if around:
                        of = around[0].of
                        both, known = around[0].shared(items)
                        every = around[0].size + len(items) - both
                        alike = np.flatnonzero((100 * both >= percent * every) & (of != x))
                        if len(alike):
                            both[alike] = np.minimum(both, around[1].shared(other(chunk, i))[0])[alike]
                            every = around[0].size + len(items) - both
                            alike = alike[100 * both[alike] >= percent * every[alike]]
                            links, linked = np.unique(of[alike]), around[0].reference in alike
                            joins = np.array(list({root[s]: s for s in links.tolist()}.values()), np.int64)
                            if len(joins) > 1:
                                one = {root[s] for s in joins.tolist()}
                                root = {s: min(one) if r in one else r for s, r in root.items()}
                        for j in np.flatnonzero(of == k[0]).tolist():
                            best = max(best, (int(both[j]), int(every[j])), key=lambda v: v[0] / v[1])
                    if around and x in root:
                        met = none, none
                    elif around and around[0].reference is not None:
                        met = around[0].buckets(items, linked, k[0], percent)
                    else:
                        met = prefixes(items, known, k[0], percent)
                    out.append((k[0], x, *best, links, joins, *met))
            c, x, both, all_, links, joins, near, far = zip(*out, strict=True) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (c, x, both, all_)), *(lists(v) for v in (links, joins, near, far))], names=["c", "x", "both", "all_", "links", "joins", "near", "far"])

    return run


def _verify(texts: DataFrame, pairs: DataFrame, n_words: int, percent: int, sets: int) -> DataFrame:
    """_TESTED: the members x of each centre c of ``pairs`` (c, x) compared, on full sets, with it and the smallest of each
    of ``sets`` - 1 parts of them. Of rows that share the id c the most alike counts, each of x is a row."""
    count = pairs.count()
    n = min(partitions(texts.sparkSession), 1 + count // TASK)  # later rounds have few members
    # four times as many parts as wanted: of a group that isn't larger than ``sets`` nearly all are taken
    around = pairs.groupBy("c", F.pmod(F.xxhash64("x"), F.lit(4 * sets)).alias("part")).agg(F.min("x").alias("s"), F.count(F.lit(1)).alias("w"))
    taken = F.slice(F.array_sort(F.collect_list(F.struct("part", "s"))), 1, sets - 1)["s"]
    sized = around.groupBy("c").agg(F.sum("w").alias("w"), F.concat(F.array("c"), taken).alias("sets"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(1 << 20)))
    salts = materialize(sized.withColumn("salts", F.ceil(F.col("w") / STAR)))
    members = join_unique(salted, salts.drop("sets"), ["c"], "w", count, "inner").select("c", (F.col("salt") % F.col("salts")).alias("salt"), "x", F.lit(None).cast("long").alias("s"))
    own = salts.select("c", "salts", F.explode("sets").alias("s")).select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("x"), "s")
    there = texts.select(F.col("doc_id").alias("_id"), "text")
    rows = members.unionByName(own).withColumn("_id", F.coalesce("x", "s")).join(there.hint("merge"), "_id")
    rows = rows.select("c", "salt", "x", "s", "text").repartition(n, "c", "salt").sortWithinPartitions("c", "salt", F.col("x").asc_nulls_first(), "s", F.xxhash64("text"))
    return rows.mapInArrow(_compare(n_words, percent), _TESTED)


def near_dedup(docs: DataFrame, percent: int = 85, n_words: int = 3, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts with the same set of shingles are one class, whose smallest doc_id stands for it; only classes
    are compared. Sketches of ``bands`` * ``rows`` bins are banded. In every bucket with several
    classes, the smallest is the centre; all members of a centre are compared with it and some of them (SETS, in later
    rounds up to MOST_SETS, so that most groups end in the first), on full sets, by inverted lists.
    Jaccard distance is a metric: with c the centre, x linked to c and y not, x and y can't be linked if
    d(c, y) > d(c, x) + (1 - percent / 100). So members linked to their centre are done unless some
    unlinked one is that near, and so are those that all others were compared with. The rest go on to the next
    round's buckets, by prefixes(): those that can be linked with each other meet there, while others of a
    family with much in common part. A bucket whose members are all of one component is done, and one whose members all
    have a smaller centre in common, the smallest of each, is left to that centre's. Rounds end
    when no bucket has two members left, which must come, as members' ids are above those of all their
    centres so far. So no link between members of a bucket goes untested that could join components, and no
    bucket's pairs are all listed.
    Two sets at the threshold share no bucket with probability (1 - 0.85^6)^32 < 3e-7.

    Nulls: a null text counts as empty. Documents without words have an empty set and link with nothing.
    A null doc_id can't name a component: such rows link with nothing, component_id is null, kept true.
    Rows that share a doc_id are one document with several texts. Long texts are whole. Empty input
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketched = materialize(d.mapInArrow(_sketches(n_words, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"))
    key = ["s1", "s2"]
    usable = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(usable.groupBy(*key).agg(F.min("doc_id").alias("x"), F.count(F.lit(1)).alias("w")))
    total = classes.agg(F.sum("w")).first()[0] or 0
    heads = join_unique(usable, classes, key, "w", total, "inner").where("doc_id = x").select("x", F.col("bands").alias("near"), F.array().cast("array<long>").alias("far"))
    open_ = materialize(heads.distinct().select("x", F.lit(0).cast("long").alias("main"), F.lit(True).alias("own"), "near", "far"))
    links, reach, named, sets, here = materialize(spark.createDataFrame([], "a long, b long")), 1 - percent / 100, None, SETS, d
    while True:
        flag = lambda c, near: F.transform(c, lambda v: F.struct(v.alias("bucket"), F.lit(near).alias("near")))
        placed = open_.select("x", "main", "own", F.explode(F.concat(flag("near", True), flag("far", False))).alias("b")).select("x", "main", "own", "b.*")
        tagged = placed.withColumn("to", F.col("x")) if named is None else placed.join(named, "x", "left").withColumn("to", F.coalesce("to", "x"))
        buckets = tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("c"), F.max("near").alias("some"), (F.min("to") != F.max("to")).alias("apart"), (F.max("own") | (F.min("main") != F.max("main"))).alias("new"))
        buckets = materialize(buckets.where("n > 1 AND apart AND some AND new").select("bucket", "n", "c"))
        met = may_pass(placed.select("x", "bucket"), key_filter(buckets, "bucket"), "bucket")
        pairs = join_unique(met, buckets, ["bucket"], "n", buckets.agg(F.sum("n")).first()[0] or 0, "inner").where("x != c")
        pairs = materialize(pairs.select("c", "x").distinct())
        discard(buckets)
        if not pairs.limit(1).count():
            break
        ends = pairs.select(F.xxhash64("c").alias("k")).unionByName(pairs.select(F.xxhash64("x").alias("k")))
        # members of later rounds are among this one's, so that only these texts are read again
        wanted = materialize(may_pass(here.withColumn("_k", F.xxhash64("doc_id")), key_filter(ends, "k"), "_k").select("doc_id", "text"))
        tested = materialize(_verify(wanted, pairs, n_words, percent, sets).withColumn("linked", F.array_contains("links", F.col("c"))).drop("links"))
        more = materialize(links.unionByName(tested.select(F.explode("joins").alias("a"), F.col("x").alias("b"))).distinct())
        linked, dist = F.col("linked"), 1 - F.col("both") / F.col("all_")
        near = tested.groupBy("c").agg(F.min(F.when(~linked, dist)).alias("least"), F.count(F.lit(1)).alias("m")).where("least IS NOT NULL")
        rest = join_unique(tested.where(F.size("near") > 0), near, ["c"], "m", tested.count(), "inner").where(~linked | (F.col("least") <= dist + reach + 1e-9))
        # two members of a centre that have a smaller one in common meet by that one's buckets
        main = tested.groupBy("x").agg(F.min("c").alias("main"))
        left = materialize(rest.select("c", "x", "near", "far").join(main, "x").select("x", "main", (F.col("main") == F.col("c")).alias("own"), "near", "far"))
        discard(links, open_, pairs, tested, here)
        here, links, open_, sets = wanted, more, left, min(MOST_SETS, 4 * sets)
        named = components(links).select(F.col("node").alias("x"), F.col("component").alias("to"))
    discard(open_, pairs, here)
    edges = links
    twice = usable.groupBy("doc_id").agg((F.min("s1") != F.max("s1")).alias("several")).where("several").select("doc_id")
    same_id = join_unique(usable.join(twice, "doc_id", "left_semi").select("doc_id", *key), classes, key, "w", total, "inner").where("doc_id != x")
    edges = edges.unionByName(same_id.select(F.col("doc_id").alias("a"), F.col("x").alias("b")))
    comps = components(edges)
    named = classes.join(comps.withColumnRenamed("node", "x"), "x", "left").select(*key, "w", F.coalesce("component", "x").alias("component"))
    linkable = join_unique(usable.select("doc_id", "n_shingles", *key), named, key, "w", total, "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = sketched.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linkable.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
