"""What the operators of this package share: input columns, shared files, skew-safe joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bound_batches, scratch

#: A key holding at least this share of all rows is hot; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 1000


def by_place(df: DataFrame, **want: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by place, c0, c1, ..., and the names there of those in ``want``.

    Columns are found by exact name first, then without regard to case; of several of one name
    the first counts. Other columns, whatever their names, can't clash with an operator's own.
    """
    bound_batches(df.sparkSession)
    names = df.columns
    folded = [n.lower() for n in names]
    spots = {}
    for new, old in want.items():
        if old in names:
            spots[new] = f"c{names.index(old)}"
        elif old.lower() in folded:
            spots[new] = f"c{folded.index(old.lower())}"
        else:
            raise ValueError(f"no column {old!r} among {names}")
    return df.toDF(*[f"c{i}" for i in range(len(names))]), spots


def pick(df: DataFrame, **want: str) -> DataFrame:
    """The columns named by ``want`` (new name = old name), found as by_place does, and no other."""
    placed, spots = by_place(df, **want)
    return placed.select(*[F.col(c).alias(new) for new, c in spots.items()])


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the folder that all executors share (spark.checkpoint.dir)."""
    return scratch(spark)


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives lost executors. discard() frees it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no plan reads any more; those that a returned plan reads stay."""
    for t in tables:
        if path := getattr(t, "_shared_path", None):
            delete(t.sparkSession, path)
            t._shared_path = None


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of shared_dir that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """``left`` joined to ``right``, which has one row per key and in ``weight`` the number of left rows of the key.

    Keys of at least HOT_SHARE of all rows, of which there can be no more than 1 / HOT_SHARE, are
    broadcast; a shuffled join takes the rest, in which no key holds more than HOT_SHARE of the rows.
    """
    least = max(2, total * HOT_SHARE)
    cols = [c for c in right.columns if c not in keys]
    hot = right.where(F.col(weight) >= least)
    n_hot = hot.limit(int(1 / HOT_SHARE) + 2).count()
    if n_hot == 0:
        return left.join(right, keys, how)
    tagged = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    warm = tagged.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), keys, how)
    cold = tagged.where(F.col("_hot").isNull()).drop("_hot").join(right.where(F.col(weight) < least), keys, how)
    out = [c for c in left.columns if c not in keys]
    return cold.select(*keys, *out, *cols).unionByName(warm.select(*keys, *out, *cols))


#: Bits of a key_filter. Bit i is bit i % 64 ^ 56 of long i // 64 % 512 in row 1 + i // 32768 (Spark's bitmap, its bytes eight to a long).
BITS = 1 << 26


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of 2^26 bits over the 64-bit hashes in ``key``: at most 2048 rows of 4 KB, however many keys.

    What passes it is a superset of the rows with such keys; it saves moving most of the others. Rows hold longs,
    as a tested row reads one in place; of a binary value Spark copies all 4 KB for each row.
    """
    slot = F.pmod(F.col(key), F.lit(BITS)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    long = lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return bits.select("_bucket", F.transform(F.sequence(F.lit(0), F.lit(511)), long).alias("_bits"))


def may_pass(df: DataFrame, filt: DataFrame, key: str, yes: bool = True) -> DataFrame:
    """The rows of ``df`` whose hash ``key`` may be among those of ``filt``, or (not ``yes``) surely isn't."""
    slot = F.pmod(F.col(key), F.lit(BITS)) + 1
    pos = F.bitmap_bit_position(slot).cast("int")
    hit = F.coalesce(F.getbit(F.get("_bits", F.shiftright(pos, 6)), pos.bitwiseAND(63).bitwiseXOR(56)) == 1, F.lit(False))
    tested = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(filt), "_bucket", "inner" if yes else "left")
    return tested.where(hit if yes else ~hit).drop("_bucket", "_bits")
