"""Documents from files and tables, their order and their ids; results as HTML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.snippets import file_name
from ..storage import number_rows

UNRANKED = 2147483647


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return extension(path).isin([e.lower() for e in extensions])


#: Byte order marks, the longer ones first; without any a text is UTF-8.
_MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decode(raw: bytes) -> str:
    """Text of a file as its byte order mark says; what isn't valid becomes U+FFFD."""
    for mark, encoding in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(encoding, "replace")
    return raw.decode("utf-8", "replace")


_READ = "path string, text string, error string"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, errors = [], []
        for raw, size in zip(b.column("content").to_pylist(), b.column("length").to_pylist(), strict=True):
            text, error = None, None
            if raw is not None and size is not None:
                try:
                    text = decode(raw)
                except Exception as e:  # noqa: BLE001 - whatever one file has, the others are read
                    error = str(e)
            texts.append("" if raw is None else text)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])


def read_files(spark: SparkSession, root: str, extensions: Sequence[str] = (".txt",), errors: bool = False) -> DataFrame:
    """(path, text) of all files under ``root``, one row a file; paths as they are, blanks and all, not percent-encoded.

    Texts are decoded by their byte order mark. A .pdf, or any but .txt, has an empty text here, and isn't read. Files
    without a byte have no row (nothing of them would be indexed); those that can't be read are skipped; one that can't be decoded has a null text, and, with ``errors``, an error.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    found = raw.where(has_extension(F.col("path"), extensions))
    is_text = extension(F.col("path")) == ".txt"
    read = found.where(is_text).select("path", "content", "length").mapInArrow(_texts, _READ)
    out = read.unionByName(found.where(~is_text).select("path", F.lit("").alias("text"), F.lit(None).cast("string").alias("error")))
    return out if errors else out.drop("error")


def rank(name: Column, order: Sequence[str]) -> Column:
    """Place of ``name`` in ``order``, from 1; names that aren't there come last."""
    if not order:
        return F.lit(UNRANKED)
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), name), F.lit(0)), F.lit(UNRANKED)).cast("int")


def sort_key(path: Column, directories: Sequence[str] = (), files: Sequence[str] = ()) -> Column:
    """A string by which paths sort as folders are walked: at each level folders first, listed names first, then by name."""
    parts = F.split(path, r"[\\/]")
    last = F.size(parts) - 1

    def key(name: Column, i: Column) -> Column:
        is_file = i == last
        place = F.when(is_file, rank(F.regexp_replace(name, r"\.[^.]*$", ""), files)).otherwise(rank(name, directories))
        return F.concat(F.when(is_file, "1").otherwise("0"), F.lpad(place.cast("string"), 10, "0"), name)

    return F.array_join(F.transform(parts, key), "\x01")


def normal_root(root: str) -> str:
    return root if root.endswith(("/", "\\")) else root + "/"


def relative(path: Column, root: str) -> Column:
    """Without the root, wherever it occurs, and without separators at either end; lookups use the same form."""
    return F.regexp_replace(F.replace(path, F.lit(normal_root(root)), F.lit("")), r"^[\\/]+|[\\/]+$", "")


def assign_ids(paths: DataFrame, registry: DataFrame, root: str = "", directories: Sequence[str] = (), files: Sequence[str] = ()) -> DataFrame:
    """``registry`` (doc_id, path, sort_key) with the new ones of ``paths`` (path): known paths keep their id,
    others get the next ones in canonical order."""
    rel = relative(F.col("path"), root) if root else F.col("path")
    given = paths.select(rel.alias("path")).distinct()
    new = given.join(registry.select("path"), "path", "left_anti").withColumn("sort_key", sort_key(F.col("path"), directories, files))
    start = registry.agg(F.max("doc_id")).first()[0] or 0
    return registry.select("doc_id", "path", "sort_key").unionByName(number_rows(new, ["sort_key", "path"], "doc_id", start).select("doc_id", "path", "sort_key"))


def ids_of(paths: DataFrame, registry: DataFrame, root: str = "") -> DataFrame:
    """(path, doc_id), -1 where the registry lacks the path."""
    rel = relative(F.col("path"), root) if root else F.col("path")
    known = registry.select(F.col("path").alias("_rel"), "doc_id")
    return paths.select("path", rel.alias("_rel")).join(known, "_rel", "left").select("path", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))


def paths_of(ids: DataFrame, registry: DataFrame, root: str = "") -> DataFrame:
    """(doc_id, path), null where the registry lacks the id."""
    full = F.concat(F.lit(normal_root(root) if root else ""), F.col("path"))
    return ids.select("doc_id").join(registry.select("doc_id", full.alias("path")), "doc_id", "left")


def html_items(results: DataFrame) -> DataFrame:
    """(doc_id, item): a list item per snippet of (doc_id, path, snippets)."""
    item = F.concat(F.lit("<li><b>"), file_name(F.col("path")), F.lit("</b> Document id: "), F.col("doc_id").cast("string"), F.lit("<br>"), F.col("snippet"), F.lit("</li>"))
    return results.select("doc_id", "path", F.explode("snippets").alias("snippet")).select("doc_id", item.alias("item"))


def to_html(results: DataFrame, limit: int | None = None) -> str:
    """A right-to-left page of all snippets, or the first ``limit``, for people to read."""
    items = html_items(results).orderBy("doc_id")
    items = [r["item"] for r in (items if limit is None else items.limit(limit)).collect()]
    return "<html dir='rtl'><body><ol>" + "".join(items) + "</ol></body></html>"
