"""How work is spread over a cluster: bounded broadcasts, salted joins, distributed running sums.

Every operator of the library goes through these helpers whenever a plain ``join`` or ``Window``
would put an unbounded group on one task, or broadcast a table of unknown size.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, UserDefinedType

# A lookup table of this many values (rows times columns) is some tens of megabytes as numbers.
BROADCAST_VALUES = 4_000_000
# A key is hot when it holds more than this share of the rows, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001
# A hot key is spread over at least this many salts, and over more where it has many rows.
SALTS = 64
ROWS_PER_SALT = 1_000_000
# Rows without a key are dealt to so many salts: none of them has a counterpart, so many cost nothing.
NULL_SALTS = 1 << 20
# Tables of at least so many rows are dealt evenly before fits pass over them hundreds of times, at most so many rows to a task.
EVEN_ROWS = 2_000_000
ROWS_PER_TASK = 10_000_000
# Counters of the sketch of hot keys: its error is a fifth of HOT_SHARE.
TRACKED = 16_384


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder; on a cluster the missing
    setting is an error, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="polarframe-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def even(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` in equal partitions by ``keys``, as many as fill the cluster's cores a whole number of times, if the ``rows`` it is made from are many.

    A fit runs a job per level and tree over the partitions of its input: one partition more than there are cores makes each of those jobs wait for
    a second round of tasks. Windows by the same keys need no other exchange. Small tables are left to adaptive execution.
    """
    if rows < EVEN_ROWS:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * -(-rows // (cores * ROWS_PER_TASK)), *keys)


def _values(table: DataFrame, width: int | None) -> int:
    """Values of a table, in units of eight bytes: columns of variable length count by what they hold."""
    fixed, sizes = 0, []
    for f in table.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            sizes.append(F.coalesce(F.ceil(F.octet_length(f.name) / 8), F.lit(0)))
        elif isinstance(f.dataType, (ArrayType, MapType)):
            sizes.append(F.greatest(F.size(f.name), F.lit(0)).cast("bigint"))
        else:
            fixed += 1
    if width is not None or not sizes:
        return table.count() * (width or fixed)
    stats = table.agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(sizes)]).first()
    return stats["n"] * fixed + sum(stats[f"s{i}"] or 0 for i in range(len(sizes)))


def require_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df``, or an error if a key stands on several rows. Counting combines in the tasks, so a crowded key is no burden; null keys are not compared."""
    doubled = df.select(*keys).na.drop().groupBy(*keys).count().where("count > 1").select(*keys).limit(3).collect()
    if doubled:
        raise ValueError(f"{name} has several rows for {keys}, e.g. {[tuple(r) for r in doubled]}")
    return df


def lookup_join(
    df: DataFrame, table: DataFrame, on: list[str], how: str = "left", width: int | None = None, keys_from: DataFrame | None = None
) -> DataFrame:
    """Join a lookup table with one row per key: broadcast if counted small, else salted shuffle.

    ``table`` should be a scan or a settled table, so that counting it is cheap. ``width`` is the
    number of values in a row of ``table`` where that is not its number of columns (arrays).
    ``keys_from`` is passed on to ``skew_join``.
    """
    if _values(table, width) <= BROADCAST_VALUES:
        return df.join(F.broadcast(table), on, how)
    return skew_join(df, table, on, how, keys_from)


def hot_keys(df: DataFrame, on: list[str]) -> list[tuple[int, int]]:
    """(hash of the key, salts) of the keys that hold more than ``HOT_SHARE`` of the rows; rows without a key don't count.

    A frequent-items sketch: every task keeps at most ``TRACKED`` counters, and the partial sketches merge into one row, so neither the number of keys nor
    the size of a key matters, and nothing but that row is moved. At most ``1 / HOT_SHARE`` keys can be that frequent.
    """
    whole = df.na.drop(subset=on).select(F.xxhash64(*on).alias("_k"))
    most = round(1 / HOT_SHARE)
    found = whole.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_k, {most}, {TRACKED})").alias("top")).first()
    least = max(found.n * HOT_SHARE, 1.0)
    return [(r.item, max(SALTS, -(-r["count"] // ROWS_PER_SALT))) for r in found.top if r["count"] > least]


def skew_join(
    df: DataFrame, table: DataFrame, on: list[str], how: str = "left", keys_from: DataFrame | None = None
) -> DataFrame:
    """Shuffle join that spreads hot keys of ``df`` (and its null keys) over salted partitions.

    Hot keys are found by a sketch of the keys of ``df``, or of ``keys_from``: an earlier table with the same
    keys, which saves running the plan of ``df`` twice. Any choice of hot keys gives the same rows, so keys are named by their hashes.

    Only the rows of ``table`` that belong to hot keys are repeated, so a topography of hundreds
    of millions of cells is not multiplied. The list of hot keys has at most ``1 / HOT_SHARE``
    rows by construction and is safe to broadcast.
    """
    if how not in ("left", "inner"):
        raise ValueError("skew_join keeps the left side whole: how must be left or inner")
    hot = hot_keys(df if keys_from is None else keys_from, on)
    kinds = {k: (df if keys_from is None else keys_from).schema[k].dataType for k in on}
    any_null = F.lit(False)
    for key in on:
        any_null = any_null | F.col(key).isNull()
    names = df.sparkSession.createDataFrame(hot, "_key bigint, _hot int")

    def marked(side: DataFrame) -> DataFrame:
        # Equal keys hash alike only in one type; a key that does not fit it meets none of the other side.
        keyed = side.withColumn("_key", F.xxhash64(*[F.col(k).try_cast(t) for k, t in kinds.items()]))
        return keyed.join(F.broadcast(names), "_key", "left").drop("_key") if hot else keyed.withColumn("_hot", F.lit(None).cast("int")).drop("_key")

    # A hash of the row, not a random number: a retried task salts its rows as before.
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, UserDefinedType))]
    # Null keys meet no row of the table, so their salts need no counterpart.
    spread = F.pmod(F.xxhash64(*plain), F.coalesce(F.col("_hot"), F.lit(NULL_SALTS))).cast("int")
    salted = marked(df).withColumn("_salt", F.when(F.col("_hot").isNotNull() | any_null, spread).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.col("_hot") - 1)).otherwise(F.array(F.lit(0)))
    repeated = marked(table).withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def with_group_stats(df: DataFrame, keys: list[str], stats: list[Column]) -> DataFrame:
    """Add per-group aggregates to every row: map-side combined ``groupBy``, settled, looked up.

    A window partitioned by a handful of regions would put a sixth of the data on one task; this
    never moves the rows of ``df`` unless the table of groups outgrows the broadcast bound.
    """
    table = settle(df.groupBy(*keys).agg(*stats))
    return lookup_join(df, table, keys)


def prefix_sums(
    df: DataFrame,
    order: str,
    sums: list[str],
    keys: list[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Running totals ``cum_<name>`` along ``order`` inside ``keys`` without one task per key.

    Rows must be unique per (keys, order); aggregate first. The rows are range partitioned into
    slices, each slice is summed, the slice totals (one per slice and key) are cumulated, and the
    running sum inside a slice starts from that offset. A single key of any length is spread over
    all slices.
    """
    keys = list(keys or [])
    direction = F.col(order).desc() if descending else F.col(order).asc()
    # Without a number of slices, adaptive execution merges small ones. Settled, so that slice borders
    # (which come from a sample) are drawn exactly once.
    sliced = settle(
        df.repartitionByRange(*[F.col(k) for k in keys], direction)
        .withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
        .select(*keys, "_slice", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums])
    )
    placed = lookup_join(sliced, offsets, [*keys, "_slice"])
    inside = Window.partitionBy(*keys, "_slice").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns(
        {f"cum_{s}": F.sum(s).over(inside) + F.col(f"_o_{s}") for s in sums}
    ).drop("_slice", *[f"_o_{s}" for s in sums])


def keyed_uniform(keys: list[str], seed: int) -> Column:
    """Repeatable uniform number in [0, 1) that depends on the key values only.

    ``DataFrame.sample`` depends on how rows happen to be partitioned; this does not, so a retried
    task or another cluster size draws the same rows. MD5 of the key text is a function any SQL
    engine has, so the draw can be checked outside Spark; 13 hex digits fit a double exactly.
    """
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))
