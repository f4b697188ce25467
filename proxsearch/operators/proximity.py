"""Ordered adjacency over position lists: the next occurrence of each term, within a distance, never going back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import bound_batches


def chains(lists: list[Column], adjacency: int) -> Column:
    """Matches, as arrays of postings, of the terms' posting arrays (each in order of position).

    Every posting of the first term starts a chain; each next term gives its first posting after the last
    one, at most ``adjacency`` words between, or the chain fails.
    """
    reach = adjacency + 1

    def follow(acc: Column, later: Column) -> Column:
        at = F.element_at(acc, -1)["position"]
        return F.concat(acc, F.slice(F.filter(later, lambda x: (x["position"] > at) & (x["position"] <= at + reach)), 1, 1))

    def chain(start: Column) -> Column:
        acc = F.array(start)
        if len(lists) > 1:
            # a failed step leaves acc short, and each later one could only lengthen it: size tells
            acc = F.aggregate(F.array(*[F.struct(p.alias("p")) for p in lists[1:]]), F.struct(acc.alias("acc"), F.lit(0).alias("n")), lambda s, q: F.struct(F.when(F.size(s["acc"]) == s["n"] + 1, follow(s["acc"], q["p"])).otherwise(s["acc"]).alias("acc"), (s["n"] + 1).alias("n")), lambda s: s["acc"])
        return acc

    return F.filter(F.transform(lists[0], chain), lambda m: F.size(m) == len(lists))


def chain_rows(lists: DataFrame, n_terms: int, adjacency: int, keep_unmatched: bool = False) -> DataFrame:
    """(doc_id, matches) of rows (doc_id, l0, l1, ...): as ``chains``, in time linear in the lists but for a binary search each.

    All documents of a batch go together: a posting's key is its document's place and its position, and each
    chain's next posting is found among the sorted keys of the next term. Lists may come in any order.
    """
    width, reach = 1 << 32, adjacency + 1
    bound_batches(lists.sparkSession)
    schema = lists.select("doc_id", F.array("l0").alias("matches")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, postings = [], []
            for i in range(n_terms):
                column = b.column(f"l{i}")
                flat = column.flatten()
                row = np.repeat(np.arange(b.num_rows), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                key = row * width + flat.field("position").to_numpy(zero_copy_only=False)
                order = np.argsort(key, kind="stable")
                keys.append(key[order])
                postings.append(flat.take(pa.array(order)))
            at, chosen = keys[0], [np.arange(len(keys[0]))]
            for later in keys[1:]:
                nxt = np.searchsorted(later, at, "right")
                # the key of the next document is further than any reach
                ok = nxt < len(later)
                ok[ok] = later[nxt[ok]] - at[ok] <= reach
                chosen = [c[ok] for c in chosen] + [nxt[ok]]
                at = later[nxt[ok]]
            counts = np.bincount(keys[0][chosen[0]] // width, minlength=b.num_rows)
            # postings of all terms one after another; a match takes one of each
            every = pa.concat_arrays(postings)
            base = np.cumsum([0, *map(len, postings[:-1])])
            flat = every.take(pa.array((np.stack(chosen, 1) + base).ravel()))
            n = len(chosen[0])
            matches = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_terms), flat)
            per_doc = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), matches)
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), per_doc], names=["doc_id", "matches"])
            yield out if keep_unmatched else out.filter(pa.array(counts > 0))

    return lists.mapInArrow(run, schema)


def chain_join(postings: DataFrame, n_terms: int, adjacency: int) -> DataFrame:
    """(doc_id, start, positions) by joins, for lists too long for arrays.

    ``postings``: (term_no, doc_id, position), a row each. Positions are cut into blocks as long as a step may reach, so
    that the range join is an equi-join on the one or two blocks that it may reach.
    """
    reach = adjacency + 1
    block = lambda c: F.floor(c / reach).cast("int")
    at = postings.where("term_no = 0").select("doc_id", F.col("position").alias("p0"))
    for k in range(1, n_terms):
        before, prev, nxt = [f"p{i}" for i in range(k)], F.col(f"p{k - 1}"), F.col(f"p{k}")
        later = postings.where(F.col("term_no") == k).select("doc_id", F.col("position").alias(f"p{k}"), block(F.col("position")).alias("block"))
        tried = at.withColumn("block", F.explode(F.sequence(block(prev + 1), block(prev + reach))))
        at = tried.join(later, ["doc_id", "block"]).where((nxt > prev) & (nxt <= prev + reach)).groupBy("doc_id", *before).agg(F.min(nxt).alias(f"p{k}"))
    return at.select("doc_id", F.col("p0").alias("start"), F.array(*[f"p{k}" for k in range(n_terms)]).alias("positions"))
