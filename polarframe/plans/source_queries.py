"""Sources, sinks, decoding, filters and simple transforms on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType, TimestampType

from polarframe.functions.calendar import (
    GRAVITY_EPOCH,
    OCEAN_EPOCH,
    SECONDS_PER_DAY,
    SECONDS_PER_HOUR,
    cyclic_doy,
    cyclic_month,
    decode_cf_time,
    month_idx,
    with_date_from_ns,
    with_year_month,
)
from polarframe.operators import clean
from polarframe.operators.distribute import scratch_path
from polarframe.plans.bindings import GRID, OBS, grid, obs, table, uniform_sql
from polarframe.plans.registry import query
from polarframe.sources.readers import decode_packed, read_observations, union_tiles
from polarframe.sources.schemas import PackSpec
from polarframe.sources.sinks import materialize, preview, save_predictions, write_observations

_LINE_SCHEMA = StructType([
    StructField("l_orderkey", LongType(), True),
    StructField("l_linenumber", IntegerType(), True),
    StructField("l_quantity", DoubleType(), True),
    StructField("l_shipdate", TimestampType(), True),
])


@query(
    "read_fixed_schema",
    """select l_orderkey, l_linenumber, l_quantity, year(l_shipdate) * 12 + month(l_shipdate) as month_idx
       from lineitem""",
)
def _(spark, sf):
    lines = read_observations(spark, f"{sf}/lineitem.parquet", _LINE_SCHEMA)
    months = month_idx(lines, "l_shipdate").withColumn("month_idx", F.col("month_idx").cast("bigint"))
    return months.select("l_orderkey", "l_linenumber", "l_quantity", "month_idx")


@query("date_from_ns", "select event_id, strftime(ts, '%Y-%m-%d') as day from events")
def _(spark, sf):
    ns = table(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time"))
    return with_date_from_ns(ns).select("event_id", F.date_format("time", "yyyy-MM-dd").alias("day"))


@query(
    "decode_packed",
    """select l_orderkey, l_linenumber,
         case when cast(l_quantity as int) <> 13 and l_quantity between 2 and 45 then l_quantity * 0.5 + 21 end as thetao
       from lineitem""",
)
def _(spark, sf):
    packed = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("thetao"))
    return decode_packed(packed, {"thetao": PackSpec(fill=13, scale=0.5, offset=21.0, valid_min=2, valid_max=45)})


@query(
    "decode_gravity_days",
    "select o_orderkey, epoch(o_orderdate)::bigint as seconds, year(o_orderdate) * 12 + month(o_orderdate) as month_idx from orders",
)
def _(spark, sf):
    days = table(spark, sf, "orders").select(
        "o_orderkey", F.datediff(F.col("o_orderdate"), F.lit(GRAVITY_EPOCH[:10]).cast("date")).alias("time")
    )
    decoded = decode_cf_time(days, "time", SECONDS_PER_DAY, GRAVITY_EPOCH)
    return decoded.select("o_orderkey", F.unix_timestamp("exact_time").alias("seconds"), F.col("month_idx").cast("bigint").alias("month_idx"))


@query(
    "decode_ocean_hours",
    "select l_orderkey, l_linenumber, l_partkey, epoch(l_shipdate)::bigint as seconds, year(l_shipdate) * 12 + month(l_shipdate) as month_idx from lineitem",
)
def _(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    days = F.datediff(F.col("l_shipdate"), F.lit(OCEAN_EPOCH[:10]).cast("date"))
    hours = table(spark, sf, "lineitem").select(*keys, (days * 24.0).alias("time"))
    decoded = decode_cf_time(hours, "time", SECONDS_PER_HOUR, OCEAN_EPOCH)
    return decoded.select(*keys, F.unix_timestamp("exact_time").alias("seconds"), F.col("month_idx").cast("bigint").alias("month_idx"))


_TILES = {"A1": "AUTOMOBILE", "A2": "BUILDING", "A3": "FURNITURE", "A4": "HOUSEHOLD", "A5": "MACHINERY"}


@query(
    "union_tiles",
    "select c_custkey, c_nationkey, case c_mktsegment "
    + " ".join(f"when '{segment}' then '{tile}'" for tile, segment in _TILES.items())
    + f" end as tile from customer where c_mktsegment in ({', '.join(repr(s) for s in _TILES.values())})",
)
def _(spark, sf):
    customers = table(spark, sf, "customer")
    tiles = {t: customers.filter(F.col("c_mktsegment") == s).select("c_custkey", "c_nationkey") for t, s in _TILES.items()}
    return union_tiles(tiles)


@query("write_by_month", f"with {OBS} select month_idx, count(*) as n, cast(sum(delta_h) as bigint) as delta_h from obs group by month_idx")
def _(spark, sf):
    path = scratch_path(spark, "by-month")
    write_observations(obs(spark, sf), path)
    return spark.read.parquet(path).groupBy("month_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("delta_h").alias("delta_h"))


@query("materialize", f"with {OBS} select x, month_idx, delta_h, thetao_mo from obs")
def _(spark, sf):
    return materialize(obs(spark, sf), scratch_path(spark, "flush")).select("x", "month_idx", "delta_h", "thetao_mo")


@query(
    "save_predictions",
    """select 'rule' as model, 'test' as split, case when n_chars > 1500 then 1 else 0 end as prediction, count(*) as n
       from documents group by 3""",
)
def _(spark, sf):
    root = scratch_path(spark, "predictions")
    scores = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("prediction"))
    save_predictions(scores, "rule", "test", root)
    return spark.read.parquet(root).groupBy("model", "split", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "preview",
    "select l_orderkey, l_linenumber, l_quantity from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity limit 5",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return preview(lines, ["l_orderkey", "l_linenumber", "l_quantity"], key)


@query("projection", "select l_partkey, l_quantity, l_discount from lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_discount")


@query("floating_ice", f"with {GRID} select cell_x, cell_y, mask, bed from grid where mask in (2, 3)")
def _(spark, sf):
    return clean.floating_ice(grid(spark, sf)).select("cell_x", "cell_y", "mask", "bed")


@query("sql_predicate", f"with {GRID} select cell_x, cell_y, surface from grid where mask = 3 and bed < 0")
def _(spark, sf):
    return grid(spark, sf).filter("mask = 3 and bed < 0").select("cell_x", "cell_y", "surface")


@query("season", f"with {OBS} select x, month_idx, delta_h from obs where month_idx in (1997 * 12 + 6, 1997 * 12 + 7, 1997 * 12 + 8)")
def _(spark, sf):
    return clean.season(obs(spark, sf), 1997).select("x", "month_idx", "delta_h")


@query("drop_missing", f"with {OBS} select x, month_idx, thetao_mo, so_mo from obs where thetao_mo is not null and so_mo is not null")
def _(spark, sf):
    return clean.drop_missing(obs(spark, sf), ["thetao_mo", "so_mo"]).select("x", "month_idx", "thetao_mo", "so_mo")


_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("sample_rows", f"select {', '.join(_LINE_KEY)}, l_quantity from lineitem where {uniform_sql(_LINE_KEY, 42)} < 0.01")
def _(spark, sf):
    return clean.sample_rows(table(spark, sf, "lineitem").select(*_LINE_KEY, "l_quantity"), 0.01, seed=42, key=_LINE_KEY)


@query("drop_years", f"with {OBS} select x, month_idx, lwe_mo from obs where month_idx not between 1999 * 12 + 1 and 1999 * 12 + 12")
def _(spark, sf):
    return clean.drop_years(obs(spark, sf), [1999]).select("x", "month_idx", "lwe_mo")


@query(
    "flag_and_fill",
    f"""with {OBS} select x, month_idx, case when thetao_mo is null then 0 else 1 end as ocean_valid,
        coalesce(thetao_mo, 0) as thetao_mo, coalesce(so_mo, 0) as so_mo from obs""",
)
def _(spark, sf):
    filled = clean.flag_and_fill(obs(spark, sf), "thetao_mo", ["thetao_mo", "so_mo"])
    return filled.select("x", "month_idx", "ocean_valid", "thetao_mo", "so_mo")


@query(
    "log1p_columns",
    f"""with {OBS} select x, month_idx, round(ln(1 + delta_h), 6) as log_delta_h,
        case when thetao_mo > -1 then round(ln(1 + thetao_mo), 6) end as log_thetao_mo from obs""",
)
def _(spark, sf):
    logs = clean.log1p_cols(obs(spark, sf), ["delta_h", "thetao_mo"])
    return logs.select("x", "month_idx", *[F.round(c, 6).alias(c) for c in ("log_delta_h", "log_thetao_mo")])


@query(
    "mask_indicators",
    f"""with {GRID} select cell_x, cell_y, cast(mask = 1 as int) as is_grounded, cast(mask = 2 as int) as is_transient,
        cast(mask = 3 as int) as is_floating, cast(mask = 4 as int) as is_rock from grid""",
)
def _(spark, sf):
    return clean.mask_indicators(grid(spark, sf)).drop("surface", "bed", "mask")


@query(
    "valid_range",
    f"""with {GRID} select cell_x, cell_y, case when bed between -2000 and 2000 then bed end as bed,
        case when surface between 95000 and 100000 then surface end as surface from grid""",
)
def _(spark, sf):
    return clean.valid_range(grid(spark, sf), {"bed": (-2000, 2000), "surface": (95000, 100000)}).drop("mask")


@query("month_index", "select o_orderkey, cast(year(o_orderdate) * 12 + month(o_orderdate) as int) as month_idx, cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month_of_year from orders")
def _(spark, sf):
    indexed = month_idx(table(spark, sf, "orders"), "o_orderdate")
    return with_year_month(indexed).select("o_orderkey", "month_idx", "year", "month_of_year")


@query(
    "cyclic_month",
    f"""with {OBS} select x, month_idx, round(sin(2 * pi() * ((month_idx - 1) % 12 + 1) / 12), 6) as sin_month,
        round(cos(2 * pi() * ((month_idx - 1) % 12 + 1) / 12), 6) as cos_month from obs""",
)
def _(spark, sf):
    cyclic = cyclic_month(obs(spark, sf))
    return cyclic.select("x", "month_idx", *[(F.round(c, 6) + 0.0).alias(c) for c in ("sin_month", "cos_month")])


@query(
    "cyclic_day_of_year",
    """select o_orderkey, round(sin(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) as sin_doy,
       round(cos(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) as cos_doy from orders""",
)
def _(spark, sf):
    cyclic = cyclic_doy(table(spark, sf, "orders"), "o_orderdate")
    return cyclic.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("sin_doy", "cos_doy")])
