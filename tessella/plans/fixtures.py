"""Domain tables as projections of the driver's tables. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CRATER_LON = "mod({k} * 7919, 360000) / cast(1000 as double)"
_CRATER_LAT = "mod({k} * 104729, 180000) / cast(1000 as double) - 90"
_SX, _SY = "cast(mod(l_partkey * 37, 1000) as double)", "cast(mod(l_orderkey * 53, 800) as double)"

#: name -> (source table, SQL)
TABLES: dict[str, tuple[str, str]] = {
    "runs": (
        "events",
        "select event_id as id, ts, event_type as sensor_type, value as rmse, mod(event_id * 37, 100) / cast(100 as double) as inlier_ratio, user_id as total_matches, "
        "case when mod(event_id, 7) = 0 then 'x/self_pair/a' else 'x/b' end as src_path, mod(event_id * 11, 50) / cast(50 as double) as uniformity, props as result_json from events",
    ),
    "craters": (
        "orders",
        f"select o_orderkey as crater_id, {_CRATER_LON.format(k='o_orderkey')} as lon, {_CRATER_LAT.format(k='o_orderkey')} as lat, o_totalprice / 20000 as diameter_km, 'catalog' as source from orders",
    ),
    "named_features": (
        "part",
        f"select p_partkey as feature_id, p_name as name, {_CRATER_LON.format(k='p_partkey')} as lon, {_CRATER_LAT.format(k='p_partkey')} as lat, cast(p_size as double) as diameter_km, 'gazetteer' as source from part",
    ),
    "footprints": (
        "supplier",
        "select s_suppkey as product_id, cast(mod(s_suppkey * 3, 354) as double) as lon0, cast(mod(s_suppkey * 3, 354) + 6 as double) as lon1, "
        "cast(mod(s_suppkey, 10) * 12 - 60 as double) as lat0, cast(mod(s_suppkey, 10) * 12 - 51 as double) as lat1 from supplier",
    ),
    "quads": (
        "customer",
        "select c_custkey as product_id, cast(mod(c_custkey * 17, 357) as double) as lon0, cast(mod(c_custkey * 7, 100) - 55 as double) as lat0, mod(c_custkey, 5) * cast(0.2 as double) as shear from customer",
    ),
    "match_points": (
        "lineitem",
        "select l_suppkey as run_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as match_idx, "
        f"{_SX} as src_x, {_SY} as src_y, {_SX} * 1.2 - {_SY} * 0.1 + 5 + (l_quantity - 25) / 5 as ref_x, {_SX} * 0.1 + {_SY} * 1.2 - 3 + (l_tax - 0.04) * 50 as ref_y, 1 - l_discount * 10 as confidence from lineitem",
    ),
    "keypoints": ("embeddings", "select mod(vec_id, 2) as image_id, vec_id as kp_id, embedding as descriptor, label as block from embeddings"),
    "pixels": ("events", "select cast(0 as bigint) as raster_id, cast(floor(event_id / 100) as bigint) as row, mod(event_id, 100) as col, value from events"),
    "telemetry": (
        "events",
        "select event_id as record_num, ts, cast(mod(event_id * 13, 360) as double) as azimuth, cast(mod(event_id * 7, 90) as double) as elevation from events where event_type = 'view'",
    ),
    "acquisitions": ("events", "select event_id as acq_id, ts from events where event_type = 'signup'"),
    "detections": (
        "lineitem",
        "select l_suppkey as image_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as det_id, "
        f"{_SX} as cx, {_SY} as cy, l_quantity as w, l_quantity + l_linenumber as h, 1 - l_discount * 10 as confidence, case when l_returnflag = 'R' then 'boulder' else 'crater' end as class_name from lineitem",
    ),
    "sweep_results": (
        "lineitem",
        "select l_orderkey as source_id, l_returnflag as category, 15 * (l_linenumber - 1) as x, l_quantity < 60 - 20 * (l_linenumber - 1) as validated, "
        "case when l_tax > 0.07 then null else l_tax * 1000 end as err_m, mod(l_partkey, 5) as scale_id from lineitem",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = TABLES[name]
    base = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if "ts" in base.columns:
        base = base.withColumn("ts", base["ts"].cast("timestamp"))
    return spark.sql(text.replace(f"from {source}", "from {base}", 1), base=base)


def with_tables(names: str, body: str) -> str:
    """DuckDB SQL: a WITH clause of the named domain tables before ``body`` (a SELECT, or further clauses starting with a name)."""
    parts = [f"{n} AS ({TABLES[n][1]})" for n in names.split()]
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return "WITH " + ",\n".join(parts) + "\n" + body
    return "WITH " + ",\n".join(parts) + ",\n" + body
