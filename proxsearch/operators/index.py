"""The stored index: Parquet segments by bucket of the term, with documents, vocabulary, replaced documents and manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.snippets import snippets as snippet_column
from ..functions.text import is_blank
from ..plans.query import Query, expansion, search
from ..schemas import STORED, TOKENS, VOCAB
from ..storage import filesystem, newest_text, put_numbered
from .inverted import MERGES, PACKED, bucket, build, merge_last_wins, unpacked, vocabulary

_DOCUMENT = "doc_id long, path string"
_GONE = "segment string, doc_id long"
#: How segments are laid out: 2 has postings in bytes. Others are refused.
FORMAT = 2
#: Replaced and deleted documents up to this number (16 MB) are broadcast to searches; more are joined by shuffle.
BROADCAST_GONE = 1 << 20


class Index:
    """An index under ``path``.

    ``append`` writes a segment: postings by bucket of the term, its documents, its share of the vocabulary, and
    which documents of earlier segments it replaces. A document that is appended again replaces its older self (or, with
    merge_policy="term_last_wins", only the words it still has). ``delete`` lists documents as gone from the present
    segments; ``compact`` rewrites everything as one segment, and leaves the files of before to
    ``vacuum``, as plans made before still read them. A step counts once a numbered manifest names it, in a folder of
    a name of its own: a failed or repeated step does no harm, and of two writers at once one gets an error.

    Opening checks that every file the manifest names is there, and that it is of this ``FORMAT``. ``create``: whether to begin an index where there is none.
    Document ids should be unique within a batch; null ids are left out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, tag_mode: str = "clean", case: str = "first_spelling", merge_policy: str = "replace", create: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        text = newest_text(spark, f"{self.path}/manifests")
        if text is None:
            fs, where = filesystem(spark, self.path)
            if not create or fs.exists(where) and len(fs.listStatus(where)):
                raise FileNotFoundError(f"no index at {path}")
        self.state = json.loads(text) if text else {"version": 0, "format": FORMAT, "buckets": buckets, "tag_mode": tag_mode, "case": case, "merge_policy": merge_policy, "segments": [], "gone": [], "n_gone": 0, "vocabulary": [], "old": []}
        if self.state.get("format") != FORMAT:
            raise ValueError(f"the index at {path} is of another format; build it anew")
        if self.state["merge_policy"] not in MERGES:
            raise ValueError(f"merge_policy: {self.state['merge_policy']!r}")
        for name in self._files():
            fs, where = filesystem(spark, f"{self.path}/{name}/_SUCCESS")
            if not fs.exists(where):
                raise FileNotFoundError(f"{path} lacks {name}")

    def _files(self) -> list[str]:
        return [*(f"{kind}/{s}" for s in self.state["segments"] for kind in ("tokens", "documents")), *(f"gone/{g}" for g in self.state["gone"]), *(f"vocabulary/{v}" for v in self.state["vocabulary"])]

    def _commit(self, **new: object) -> None:
        """The next manifest; fails, and changes nothing, if another writer was faster."""
        state = self.state | new | {"version": self.state["version"] + 1}
        put_numbered(self.spark, f"{self.path}/manifests", state["version"], json.dumps(state))
        self.state = state

    def _read(self, kind: str, names: list[str], schema: object) -> DataFrame:
        paths = [f"{self.path}/{kind}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write_tokens(self, rows: DataFrame, name: str) -> DataFrame:
        n = self.state["buckets"]
        rows = rows.select("term", F.col("doc_id").cast("long").alias("doc_id"), "n", "packed", bucket(F.col("term"), n).alias("bucket"))
        # hot terms are many rows of one bucket: AQE splits what a rebalance makes too large
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/tokens/{name}")
        return self._read("tokens", [name], STORED)

    def _write_gone(self, ids: DataFrame, name: str) -> int:
        """Lists the documents of ``ids`` as gone from those of the present segments that hold them; returns how many."""
        held = None
        for s in self.state["segments"]:
            part = self._read("documents", [s], _DOCUMENT).select(F.lit(s).alias("segment"), "doc_id")
            held = part if held is None else held.unionByName(part)
        if held is None:
            held = self.spark.createDataFrame([], _GONE)
        found = held.join(ids, "doc_id", "left_semi").join(self._gone(), ["segment", "doc_id"], "left_anti")
        found.select("segment", "doc_id").write.parquet(f"{self.path}/gone/{name}")
        return self._read("gone", [name], _GONE).count()

    def _gone(self) -> DataFrame:
        return self._read("gone", self.state["gone"], _GONE)

    def _replaces(self) -> bool:
        return self.state["merge_policy"] == "replace"

    def _counts(self, name: str, new: DataFrame | None, gone: DataFrame | None, n_gone: int = 0) -> list[str]:
        """The vocabulary's files with another: what ``new`` postings add and the ``n_gone`` documents of ``gone`` take."""
        counted = lambda rows: rows.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("n").alias("coll_freq"))
        parts = [] if new is None else [counted(new)]
        if gone is not None:
            some = F.broadcast(gone) if n_gone <= BROADCAST_GONE else gone
            taken = self._stored().join(some, ["segment", "doc_id"], "left_semi")
            parts.append(counted(taken).select("term", (-F.col("doc_freq")).alias("doc_freq"), (-F.col("coll_freq")).alias("coll_freq")))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        both.write.option("compression", "zstd").parquet(f"{self.path}/vocabulary/{name}")
        return [*self.state["vocabulary"], name]

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, tasks: int | None = None, **also: object) -> str:
        """Indexes ``docs`` as a new segment and returns its name; ``path_col``: where the document is from, for ``find``.

        ``tasks``: texts are spread over so many first, for sources that come in fewer parts than there are cores. ``also`` enters the manifest in the same step.
        """
        name = uuid.uuid4().hex
        some = docs.where(F.col(id_col).isNotNull() & ~is_blank(F.col(text_col)))
        if tasks:
            some = some.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition(tasks)
            id_col_, text_col_ = "doc_id", "text"
        else:
            id_col_, text_col_ = id_col, text_col
        rows = self._write_tokens(build(some, id_col_, text_col_, self.state["tag_mode"], self.state["case"], rows=PACKED, by_term=True), name)
        path = (F.col(path_col) if path_col else F.lit(None)).cast("string").alias("path")
        docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), path).dropDuplicates(["doc_id"]).write.option("compression", "zstd").parquet(f"{self.path}/documents/{name}")
        new = {"segments": [*self.state["segments"], name]}
        gone, n = None, 0
        if self._replaces() and self.state["segments"]:
            n = self._write_gone(self._read("documents", [name], _DOCUMENT), name)
            new |= {"gone": [*self.state["gone"], name], "n_gone": self.state["n_gone"] + n}
            gone = self._read("gone", [name], _GONE) if n else None
        self._commit(**new, vocabulary=self._counts(name, rows, gone, n), **also)
        return name

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents of ``ids`` (doc_id) out of all present segments; unknown ids are ignored."""
        name = uuid.uuid4().hex
        n = self._write_gone(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), name)
        if n:
            self._commit(gone=[*self.state["gone"], name], n_gone=self.state["n_gone"] + n, vocabulary=self._counts(name, None, self._read("gone", [name], _GONE), n))

    def delete_paths(self, paths: DataFrame) -> None:
        """As ``delete``, of documents by ``path``; unknown paths are ignored."""
        self.delete(self.documents().join(paths.select("path"), "path", "left_semi").select("doc_id"))

    def documents(self) -> DataFrame:
        """(doc_id, path) of the documents as of now; of one that is in several segments the last path."""
        out = None
        for i, s in enumerate(self.state["segments"]):
            part = self._read("documents", [s], _DOCUMENT).select(F.lit(s).alias("segment"), F.lit(i).alias("_at"), "doc_id", "path")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], _DOCUMENT)
        return self._left(out).groupBy("doc_id").agg(F.max_by("path", "_at").alias("path"))

    def _left(self, rows: DataFrame) -> DataFrame:
        """``rows`` (segment, doc_id, ...) without what is gone; no join where nothing is."""
        if not self.state["n_gone"]:
            return rows
        gone = self._gone()
        return rows.join(F.broadcast(gone) if self.state["n_gone"] <= BROADCAST_GONE else gone, ["segment", "doc_id"], "left_anti")

    def _stored(self) -> DataFrame:
        every = None
        for i, s in enumerate(self.state["segments"]):
            part = self._read("tokens", [s], STORED).withColumns({"segment": F.lit(s), "segment_id": F.lit(i)})
            every = part if every is None else every.unionByName(part)
        return self.spark.createDataFrame([], STORED).withColumns({"segment": F.lit(""), "segment_id": F.lit(0)}) if every is None else every

    def _now(self, wanted: object = None) -> DataFrame:
        """The rows of ``tokens`` as they are stored."""
        stored = self._stored()
        left = self._left(stored if wanted is None else stored.where(wanted))
        if self._replaces() or len(self.state["segments"]) < 2:
            return left.select(*STORED.names)
        merged = merge_last_wins(left.withColumn("postings", F.struct("n", "packed")))
        return merged.select("term", "doc_id", "postings.*", bucket(F.col("term"), self.state["buckets"]).alias("bucket"))

    def tokens(self, wanted: object = None) -> DataFrame:
        """(term, doc_id, postings, bucket) as of now, of the rows with ``wanted`` (a condition on term and bucket) if given.

        The condition reaches every segment's scan; gone documents are left out by one small join.
        """
        return self._now(wanted).withColumn("postings", unpacked(F.col("n"), F.col("packed"))).select(*TOKENS.names)

    def postings(self, *terms: str) -> DataFrame:
        """(term, doc_id, postings) of the ``terms``, from their buckets alone."""
        n = self.state["buckets"]
        wanted = F.col("term").isin(*terms) & F.col("bucket").isin(*[b for b in self.spark.range(1).select(*[bucket(F.lit(t), n).alias(f"b{i}") for i, t in enumerate(terms)]).first()])
        return self.tokens(wanted).select("term", "doc_id", "postings")

    def vocabulary(self) -> DataFrame:
        """(term, doc_freq, coll_freq), from what the segments stored of it."""
        if not self._replaces():
            return vocabulary(self.tokens())
        parts = self._read("vocabulary", self.state["vocabulary"], VOCAB)
        return parts.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("coll_freq").alias("coll_freq")).where("doc_freq > 0")

    def by_key(self, *keys: str) -> DataFrame:
        """(term, doc_id, postings) of the terms whose SHA-256, in hexadecimal, is one of ``keys``."""
        return self.tokens(F.sha2("term", 256).isin(*[k.lower() for k in keys])).select("term", "doc_id", "postings")

    def compact(self) -> None:
        """One segment of all; the files of before stay until the next ``compact`` or ``vacuum``."""
        if len(self.state["segments"]) + len(self.state["gone"]) + len(self.state["vocabulary"]) < 3:
            return
        before, older, name = self._files(), self.state["old"], uuid.uuid4().hex
        rows = self._write_tokens(self._now(), name)
        self.documents().write.option("compression", "zstd").parquet(f"{self.path}/documents/{name}")
        self._counts(name, rows, None)
        self._commit(segments=[name], gone=[], n_gone=0, vocabulary=[name], old=before)
        self._remove(older)

    def vacuum(self) -> None:
        """Deletes the files of before the last ``compact``, which nothing should read any more."""
        old = self.state["old"]
        self._commit(old=[])
        self._remove(old)

    def _remove(self, names: list[str]) -> None:
        for name in names:
            fs, where = filesystem(self.spark, f"{self.path}/{name}")
            fs.delete(where, True)

    def expand(self, query: Query) -> DataFrame:
        return expansion(self.vocabulary(), query)

    def search(self, text: str, adjacency: int = 2, budget: str = "scaled", keep_unmatched: bool = False, limit: int | None = None, ordered: bool = True) -> DataFrame:
        """(doc_id, matches) in ascending order of doc_id, the first ``limit`` if given; not ``ordered``, rows come as they are found; literal terms prune buckets and reach the scans as filters."""
        query = Query(text, adjacency, budget, keep_unmatched, fold=self.state["case"] == "fold")
        found = search(self.tokens, query, self.state["buckets"], ordered)
        return found if limit is None else found.limit(limit)

    def snippets(self, results: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100) -> DataFrame:
        """``results`` with their snippets; only the found documents' texts move."""
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
        return results.join(texts, "doc_id", "left").withColumn("snippets", snippet_column(F.col("_text"), F.col("matches"), window)).drop("_text")

    def find(self, text: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, **how: object) -> DataFrame:
        """(doc_id, path, matches, snippets) of a search, in ascending order of doc_id: what a result list shows."""
        found = self.search(text, **how).join(self.documents(), "doc_id", "left")
        return self.snippets(found, docs, id_col, text_col, window).select("doc_id", "path", "matches", "snippets").orderBy("doc_id")
