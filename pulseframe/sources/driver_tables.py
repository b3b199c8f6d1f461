"""Reads the supplied `events`, `orders` and `customer` tables as biometrics.

Each event yields a step-count sample and, depending on its type, a sample of
another metric.  Callers name the metrics they need, so the scan keeps only
the event types and columns those metrics use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
ORDERS = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
          "o_orderdate timestamp, o_orderpriority string")

BASE_METRICS = (S.STEPS, S.HRV, S.RESTING_HR, S.SLEEP, S.WORKOUT)
EVENT_TYPES = {
    S.STEPS: ("view", "click", "error", "signup", "purchase"),
    S.HRV: ("view", "click"),
    S.RESTING_HR: ("error",),
    S.SLEEP: ("signup",),
    S.WORKOUT: ("purchase",),
    S.SPO2: ("view",),
    S.RESPIRATORY_RATE: ("click",),
    S.WEIGHT: ("signup",),
    S.VO2MAX: ("error",),
    S.ACTIVE_ENERGY: ("purchase",),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table; its wall-clock timestamps are read as UTC instants."""
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


K = "cast(get_json_object(props, '$.k') as int)"
DEVICE = "CASE WHEN event_id % 4 = 0 THEN 'Apple Watch Series 9' ELSE 'Oura Ring' END"
WORKOUT_JSON = f"""to_json(named_struct(
    'workout_type', CASE {K} % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Cycling' ELSE 'Yoga' END,
    'duration_seconds', cast(60 * {K} as double), 'total_energy_burned_cal', value))"""
# What each metric's sample takes from its event; absent fields are the defaults.
DEFAULTS = {"value": "value", "unit": "'count/min'", "source_device": DEVICE, "ended_at": "cast(NULL as timestamp)",
            "metadata": "cast(NULL as string)", "seq": "event_id * 2 + 1"}
FIELDS = {
    S.STEPS: {"unit": "'count'", "source_device": "'iPhone'", "seq": "event_id * 2"},
    S.HRV: {"unit": "'ms'"},
    S.RESTING_HR: {},
    S.SLEEP: {"value": f"cast({K} % 6 as double)", "unit": "'category'",
              "ended_at": f"timestampadd(MINUTE, 10 + {K}, ts)"},
    S.WORKOUT: {"value": f"cast(60 * {K} as double)", "unit": "'seconds'",
                "ended_at": f"timestampadd(MINUTE, {K}, ts)", "metadata": WORKOUT_JSON},
    S.SPO2: {"value": f"0.9D + {K} / 1000D", "unit": "'%'"},
    S.RESPIRATORY_RATE: {"value": f"12 + {K} / 10D"},
    S.WEIGHT: {"value": f"60 + {K} / 5D", "unit": "'kg'"},
    S.VO2MAX: {"value": f"35 + {K} / 5D", "unit": "'ml/kg·min'"},
    S.ACTIVE_ENERGY: {"unit": "'kcal'"},
}


def samples(spark: SparkSession, sf_dir: str, *metrics: str) -> DataFrame:
    """Raw samples of the named metrics (the five base metrics by default).

    Metrics carried by different event types share one scan; only metrics that
    claim the same events need another.  Filters on user, time and metric reach
    the scans, and a report on one metric reads only its scan.
    """
    layers: list[dict[str, str]] = []  # event type -> metric, one dict per scan
    for m in metrics or BASE_METRICS:
        free = next((layer for layer in layers if not layer.keys() & set(EVENT_TYPES[m])), None)
        if free is None:
            layers.append(free := {})
        free.update(dict.fromkeys(EVENT_TYPES[m], m))
    parts = [_layer(spark, sf_dir, list(dict.fromkeys(layer.values()))) for layer in layers]
    return reduce(DataFrame.unionByName, parts)


def _quoted(types) -> str:
    return ", ".join(f"'{t}'" for t in types)


def _layer(spark: SparkSession, sf_dir: str, metrics: list[str]) -> DataFrame:
    """One scan: each event becomes the sample of the metric its type carries."""
    types = sorted({t for m in metrics for t in EVENT_TYPES[m]})
    src = events(spark, sf_dir)
    if len(types) < len(EVENT_TYPES[S.STEPS]):
        src = src.filter(f"event_type IN ({_quoted(types)})")

    def column(name: str, default: str | None) -> str:
        def of(m: str) -> str:
            return f"'{m}'" if name == "metric_type" else FIELDS[m].get(name, default)

        if len({of(m) for m in metrics}) == 1:
            return f"{of(metrics[0])} AS {name}"
        cases = " ".join(f"WHEN event_type IN ({_quoted(EVENT_TYPES[m])}) THEN {of(m)}" for m in metrics[:-1])
        return f"CASE {cases} ELSE {of(metrics[-1])} END AS {name}"

    return src.selectExpr(
        "user_id", column("metric_type", None), *[column(c, DEFAULTS[c]) for c in ("value", "unit", "source_device")],
        "ts AS started_at", *[column(c, DEFAULTS[c]) for c in ("ended_at", "metadata", "seq")])


def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year samples from `orders`, one per order at noon UTC."""
    o = spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.select(
        (F.col("o_custkey") % 100).alias("user_id"),
        F.when(urgent, S.STEPS).otherwise(S.RESTING_HR).alias("metric_type"),
        F.col("o_totalprice").alias("value"),
        F.when(urgent, "count").otherwise("count/min").alias("unit"),
        F.lit("iPhone").alias("source_device"),
        (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("o_orderkey").alias("seq"))


def resent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as a flaky client delivers them: the ring sends everything twice,
    the second copy later and with a corrected value (one higher)."""
    first = samples(spark, sf_dir)
    again = F.when(F.col("source_device") == "Oura Ring", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (first.withColumn("copy", F.explode(again))
            .withColumn("value", F.col("value") + F.col("copy"))
            .withColumn("seq", F.col("seq") + F.col("copy") * F.lit(1_000_000_000_000))
            .drop("copy"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untidy sign-ups from `customer`: each name gives an upper-case, a padded
    and a malformed address, one second apart."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.replace("c_name", F.lit("#"), F.lit("."))
    variant = F.array(
        F.upper(F.concat(name, F.lit("@Example.com"))),
        F.concat(F.lit("  "), F.lower(name), F.lit("@example.com ")),
        F.concat(name, F.lit("@nowhere")))
    return (c.select("c_custkey", F.posexplode(variant).alias("n", "email"))
            .select("email", F.timestamp_seconds(
                F.lit(1_704_067_200) + F.col("c_custkey") * 10 + F.col("n")).alias("created_at")))
