"""The stored tiers: parquet layout, upserts by deltas, merge on read, late rows and deletion.

Raw samples are stored by metric, month of `started_at` and bucket (a hash of the user), daily
summaries and the ledger of dropped keys likewise.  `manifest` keeps versions of which directories
are in force; a read is given exactly those.

* **An upsert appends** its own rows as deltas, directories of just the buckets that they fall
  into; what is stored is neither read nor written for them.  Each delta has a rule: the `last`
  delivery counts, the row that was `first`, or the one of the highest `seq`.
* **A read merges**: rows of buckets without deltas pass as they are; in the others, the delta's
  row of a key, or the stored one, counts by the rule.  Small deltas Spark joins by broadcast
  where its size check allows, and stored rows are not shuffled.  That check goes by the bytes of
  compressed files, so writes of more than `FEW` rows are not offered to it.
* **`compact` folds** deltas into their buckets; a writer folds a bucket that has gathered
  `MOST_DELTAS` of them, or one under another rule, in the same version.
* **Summaries** of days before the cut are recomputed from all raw rows of the days that new rows
  touch, which are read by their metrics, months and buckets.
* **Dropped raws** leave their keys in the ledger.  A late row of a dropped day is merged into its
  summary if its key is not there yet, once; otherwise it has been counted already and goes to the
  store's rejects.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.metrics import is_summarisable
from ..functions.numbers import half_up, ratio
from ..functions.time import as_date, before_day, day_start, local_day
from ..operators.daily import daily_summary
from ..operators.ingest import ARRIVAL, first_per_key, latest_per_key
from ..schema import DAY_KEY, SAMPLE_COLUMNS, SAMPLE_KEY, SUMMARY_COLUMNS
from . import manifest, rejects
from .manifest import Change, Directory, Version

#: Buckets of a metric-month; give `publish` more where a metric-month has many gigabytes.
BUCKETS = 4
#: Deltas that a bucket gathers before they are folded into it.
MOST_DELTAS = 8
#: Rows up to which one side of a join may be broadcast; the manifest has the number of rows of each write.
FEW = 100_000
LAST, FIRST, SEQ = "last", "first", "seq"
PARTITIONS = {"samples": ["metric_type", "month", "bucket"], "summaries": ["month", "bucket"],
              "ledger": ["metric_type", "month", "bucket"]}
KEYS = {"samples": SAMPLE_KEY, "summaries": DAY_KEY, "ledger": SAMPLE_KEY}
#: `_total` is a day's sum before rounding; a stored day with a `sample_count` of 0 has no values any more.
_COLUMNS = {"samples": SAMPLE_COLUMNS, "summaries": (*SUMMARY_COLUMNS, "_total"), "ledger": SAMPLE_KEY}
_SCRATCH: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory of the application in the shared folder that the cluster names in ``spark.checkpoint.dir``;
    `clear_scratch` deletes all of them.

    Without that setting only a session in one process (``local[n]``) gets a temporary
    folder; on a cluster it would be another one on each machine.
    """
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _SCRATCH:
            _SCRATCH[app] = tempfile.mkdtemp(prefix="pulseframe-")
        base = _SCRATCH[app]
    return f"{base.rstrip('/')}/pulseframe/{app}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has left in the shared folder, once its results have been written."""
    manifest.remove(spark, _scratch(spark))


# --- layout ----------------------------------------------------------------
def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(buckets)).cast("string").alias("bucket")


def _placed(rows: DataFrame, tier: str, buckets: int) -> DataFrame:
    day = F.col("date") if tier == "summaries" else local_day("started_at", "UTC")
    return rows.withColumn("month", F.date_format(day, "yyyy-MM")).withColumn("bucket", _bucket(buckets))


def _save(rows: DataFrame, keys: list[str], order: list[str], path: str, rows_per_file: int) -> None:
    """Rows spread over tasks by AQE's rebalance, which splits a partition far larger
    than the rest (heart rate usually is) over several tasks and files."""
    (rows.hint("rebalance", *keys).sortWithinPartitions(*dict.fromkeys([*keys, *order]))
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).mode("overwrite").parquet(path))


def _write(spark: SparkSession, root: str, tier: str, rows: DataFrame, buckets: int, **kind) -> list[Directory]:
    """Rows as a write of their own; its directories."""
    name = uuid.uuid4().hex
    placed = _placed(rows.select(*_COLUMNS[tier]), tier, buckets)
    _save(placed, PARTITIONS[tier], ["user_id", *KEYS[tier]], f"{root}/{tier}/write={name}", 20_000_000)
    return manifest.written(spark, root, tier, name, **kind)


def write_samples(samples: DataFrame, path: str, rows_per_file: int = 20_000_000) -> None:
    """Write raw samples by metric and month, without versions."""
    month = F.date_format(local_day("started_at", "UTC"), "yyyy-MM")
    _save(samples.select(*SAMPLE_COLUMNS).withColumn("month", month), ["metric_type", "month"], ["user_id", "started_at"], path,
          rows_per_file)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*SAMPLE_COLUMNS)


# --- reading ---------------------------------------------------------------
def _schema(entry: Version, tier: str) -> T.StructType:
    """A tier's columns, and those of its directories."""
    stored = T.StructType.fromJson(json.loads(entry.settings[f"{tier}_schema"]))
    own = stored.fieldNames()
    more = [T.StructField(k, T.StringType()) for k in (*PARTITIONS[tier], "write") if k not in own]
    return T.StructType(stored.fields + more)


def _scan(spark: SparkSession, root: str, tier: str, entry: Version, directories: list[Directory]) -> DataFrame:
    return manifest.scan(spark, root, tier, _schema(entry, tier), directories)


def _side(rows: DataFrame, *directories: Directory) -> DataFrame:
    """Rows that come from these directories, as a side of a join: beyond `FEW` both sides are shuffled."""
    counts = {(d.tier, d.name): d.rows for d in directories}.values()
    return rows if None not in counts and sum(counts) <= FEW else rows.hint("merge")


def _of_deltas(rows: DataFrame, tier: str, deltas: list[Directory], rule: str) -> DataFrame:
    """The row of each key that counts among deltas; within a write a key is there once."""
    versions = {d.name: d.version for d in deltas}
    if len(versions) == 1:
        return rows
    number = F.create_map(*[F.lit(x) for item in versions.items() for x in item])[F.col("write")]
    order = {LAST: [number.desc()], FIRST: [number], SEQ: [F.desc_nulls_last("seq"), number.desc()]}[rule]
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS[tier]).orderBy(*order)))
    return ranked.filter("_k = 1").drop("_k")


def _merged(spark: SparkSession, root: str, tier: str, entry: Version, directories: list[Directory]) -> DataFrame:
    """The rows of directories, of each key the one that counts."""
    key, columns = list(KEYS[tier]), list(_COLUMNS[tier])
    rule_of = {d.where: d.rule for d in directories if d.delta}
    out = _scan(spark, root, tier, entry, [d for d in directories if d.where not in rule_of]).select(*columns)
    for rule in sorted(set(rule_of.values())):
        own = [d for d in directories if rule_of.get(d.where) == rule]
        deltas, stored = [d for d in own if d.delta], [d for d in own if not d.delta]
        new = _of_deltas(_scan(spark, root, tier, entry, deltas), tier, deltas, rule).select(*columns)
        if not stored:
            out = out.unionByName(new)
            continue
        base = _scan(spark, root, tier, entry, stored).select(*columns)
        if rule == FIRST:
            new = new.join(_side(base.select(*key), *stored), key, "left_anti")
        elif rule == SEQ:
            sent = _side(new.select(*key, F.col("seq").alias("_seq"), F.lit(True).alias("_sent")), *deltas)
            # Of equal numbers the delta's row counts, and one without a number comes before all others.
            newer = F.col("seq").isNotNull() & (F.col("_seq").isNull() | (F.col("seq") > F.col("_seq")))
            ahead = base.join(sent, key).filter(newer).select(*key)
            base = base.join(sent, key, "left").filter(F.col("_sent").isNull() | newer)
            new = new.join(_side(ahead, *deltas), key, "left_anti")
        else:
            base = base.join(_side(new.select(*key), *deltas), key, "left_anti")
        out = out.unionByName(base.select(*columns)).unionByName(new.select(*columns))
    return out


def _entry(spark: SparkSession, root: str, directories: bool = True) -> Version:
    entry = manifest.current(spark, root, directories)
    if entry is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return entry


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the version in force, 0 before the first publish."""
    return (manifest.numbers(spark, root) or [0])[-1]


def raw_from(spark: SparkSession, root: str):
    """The first local day that counts as raw, the `raw_from` to give the reports; None
    before the first retention run, when all raw samples count."""
    cut = _entry(spark, root, directories=False).settings["cut"]
    return as_date(cut) if cut else None


def _quantities(spark: SparkSession, directories: list[Directory]) -> set[str]:
    """The metrics among directories that summaries stand for."""
    found = sorted({d.value("metric_type") for d in directories})
    rows = spark.createDataFrame([(m,) for m in found], "metric_type string").filter(is_summarisable()).collect()
    return {r[0] for r in rows}


def _stored_summaries(spark: SparkSession, root: str, entry: Version, directories: list[Directory]) -> DataFrame:
    rows = _merged(spark, root, "summaries", entry, directories)
    return rows.filter(F.coalesce("sample_count", F.lit(1)) > 0)


def open_tiers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(samples, summaries) in force, either of which may be empty.  Raw quantities from
    before the cut, which their summaries stand for, are left out; directories of months that
    ended before it are not even listed."""
    entry = _entry(spark, root)
    wanted, cut, tz = entry.of("samples"), entry.settings["cut"], entry.settings["tz"]
    if cut:
        first, gone = str(day_start(cut, tz))[:7], _quantities(spark, wanted)
        wanted = [d for d in wanted if d.value("month") >= first or d.value("metric_type") not in gone]
    samples = _merged(spark, root, "samples", entry, wanted)
    if cut:
        samples = samples.filter(~before_day("started_at", cut, tz) | ~is_summarisable())
    summaries = _stored_summaries(spark, root, entry, entry.of("summaries"))
    return samples.select(*SAMPLE_COLUMNS), summaries.select(*SUMMARY_COLUMNS)


def stored_samples(spark: SparkSession, root: str) -> DataFrame:
    """All raw samples on disk, also those that summaries stand for."""
    entry = _entry(spark, root)
    return _merged(spark, root, "samples", entry, entry.of("samples"))


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """Late samples that were not merged and what imports quarantined, in the layout of `rejects`."""
    if not manifest.names(spark, f"{root}/rejects"):
        return spark.createDataFrame([], f"{rejects.LAYOUT}, run string")
    return rejects.read(spark, f"{root}/rejects")


# --- changes ---------------------------------------------------------------
def publish(spark: SparkSession, root: str, samples: DataFrame, summaries: DataFrame, buckets: int = BUCKETS) -> int:
    """Write both tiers in full as a new version and make it current."""
    summaries = summaries.select(*SUMMARY_COLUMNS).withColumn("_total", F.col("sum_value").cast("double"))
    schemas = {"samples": samples.select(*SAMPLE_COLUMNS).schema, "summaries": summaries.schema,
               "ledger": samples.select(*SAMPLE_KEY).schema}
    added = [*_write(spark, root, "samples", samples, buckets), *_write(spark, root, "summaries", summaries, buckets)]
    settings = {f"{t}_schema": s.json() for t, s in schemas.items()} | {
        "buckets": buckets, "cut": None, "tz": None, "dropped_before": None}
    return manifest.transact(spark, root, lambda entry: Change(added, set(entry.directories), settings))


def _valid(rows: DataFrame) -> DataFrame:
    """Rows with a whole key; `ingest.rejected_samples` has the others, with the reason."""
    columns = [*SAMPLE_COLUMNS, *(c for c in (ARRIVAL,) if c in rows.columns)]
    return rows.filter(F.col("user_id").isNotNull() & F.col("started_at").isNotNull()
                       & (F.trim("metric_type") != "")).select(*columns)


def _places(rows: DataFrame, tier: str, buckets: int) -> set[tuple]:
    """The partitions that rows fall into; as many as there are directories at most."""
    found = _placed(rows, tier, buckets).select(*PARTITIONS[tier]).distinct().collect()
    return {(tier, tuple(zip(PARTITIONS[tier], r))) for r in found}


def _around(spark: SparkSession, days: DataFrame, buckets: int) -> set[tuple]:
    """The partitions of samples that local days may reach into."""
    near = F.explode(F.array(F.date_sub("date", 1), F.col("date"), F.date_add("date", 1))).alias("date")
    found = days.select("metric_type", near, _bucket(buckets)).select(
        "metric_type", F.date_format("date", "yyyy-MM").alias("month"), "bucket").distinct().collect()
    return {("samples", tuple(zip(PARTITIONS["samples"], r))) for r in found}


def _fold(spark: SparkSession, root: str, entry: Version, places: set[tuple]) -> Change:
    """New directories for places, with their deltas folded in."""
    added, removed = [], set()
    for tier in sorted({t for t, _ in places}):
        old = entry.of(tier, lambda d: d.where in places)
        added += _write(spark, root, tier, _merged(spark, root, tier, entry, old), entry.settings["buckets"])
        removed |= set(old)
    return Change(added, removed, places=places)


def compact(spark: SparkSession, root: str, most: int = 0) -> int:
    """Fold the deltas of all buckets that have more than `most`, and pieces of the ledger alike; the version in force."""
    def build(entry: Version) -> Change | None:
        places = _with_deltas(entry, most)
        return _fold(spark, root, entry, places) if places else None

    return manifest.transact(spark, root, build)


def _with_deltas(entry: Version, most: int) -> set[tuple]:
    count: dict[tuple, int] = {}
    for d in entry.directories:
        if d.delta or d.tier == "ledger":  # whose first directory is what the others are added to
            count[d.where] = count.get(d.where, -1 if d.tier == "ledger" else 0) + 1
    return {w for w, n in count.items() if n > most}


def _in_the_way(entry: Version, added: list[Directory]) -> set[tuple]:
    """Places whose deltas must be folded before these are put on top."""
    rules = {d.where: d.rule for d in added}
    return {w for w in _with_deltas(entry, MOST_DELTAS - 1) if w in rules} | {
        d.where for d in entry.directories if d.delta and rules.get(d.where, d.rule) != d.rule}


class Delivery:
    """New rows on their way into the store; written once, however often the version must be built again."""

    def __init__(self, spark: SparkSession, root: str, new: DataFrame, rule: str):
        self.spark, self.root, self.rule, self.id = spark, root, rule, uuid.uuid4().hex
        rows = _valid(new)
        self.rows = (first_per_key(rows) if rule == FIRST else latest_per_key(rows)).select(*SAMPLE_COLUMNS)
        self.written: dict[tuple, tuple[list[Directory], DataFrame | None]] = {}

    def put(self, entry: Version) -> tuple[list[Directory], DataFrame | None]:
        """(deltas of samples, rows of dropped days)."""
        dropped, buckets = entry.settings["dropped_before"], entry.settings["buckets"]
        if (dropped, buckets) not in self.written:
            rows, late = self.rows, None
            if dropped:
                path = shared_dir(self.spark, "delivery")
                rows.write.parquet(path)
                rows = self.spark.read.schema(rows.schema).parquet(path)
                gone = before_day("started_at", dropped, entry.settings["tz"]) & is_summarisable()
                rows, late = rows.filter(~gone), rows.filter(gone)
            self.written[dropped, buckets] = (
                _write(self.spark, self.root, "samples", rows, buckets, delta=True, rule=self.rule), late)
        return self.written[dropped, buckets]

    def change(self, entry: Version) -> Change:
        spark, root, cut, tz = self.spark, self.root, entry.settings["cut"], entry.settings["tz"]
        buckets = entry.settings["buckets"]
        added, late = self.put(entry)
        places = {d.where for d in added}
        summaries: list[DataFrame] = []
        before = [d for d in added if cut and d.value("month") <= str(day_start(cut, tz))[:7]]
        if before:
            own = _scan(spark, root, "samples", entry, before)
            days = own.filter(before_day("started_at", cut, tz) & is_summarisable()).select(
                "user_id", "metric_type", local_day("started_at", tz).alias("date"))
            near = _around(spark, days, buckets)
            if near:
                places |= near
                new = [replace(d, version=entry.number + 1) for d in added]
                raw = _merged(spark, root, "samples", entry, [d for d in [*entry.of("samples"), *new] if d.where in near])
                on_days = raw.withColumn("date", local_day("started_at", tz)).join(
                    _side(days.distinct(), *before), list(DAY_KEY), "left_semi")
                summaries.append(daily_summary(on_days, tz, exact=True).select(*_COLUMNS["summaries"]))
        if late is not None:
            fresh, known = _by_ledger(spark, root, entry, late, buckets)
            ledger = _write(spark, root, "ledger", fresh.select(*SAMPLE_KEY), buckets)
            if ledger:
                added = [*added, *ledger]
                months = _places(fresh.withColumn("date", local_day("started_at", tz)), "summaries", buckets)
                places |= months
                old = _stored_summaries(spark, root, entry, entry.of("summaries", lambda d: d.where in months))
                summaries.append(_with_late(old, daily_summary(fresh, tz, exact=True), ledger))
            rejects.keep(_counted(known), f"{root}/rejects", self.id)
        if summaries:
            both = summaries[0] if len(summaries) == 1 else summaries[0].unionByName(summaries[1])
            added = [*added, *_write(spark, root, "summaries", both, buckets, delta=True, rule=LAST)]
        places |= {d.where for d in added}
        fold = _in_the_way(entry, [d for d in added if d.delta])
        if fold:
            folded = _fold(spark, root, entry, fold)
            return Change([*folded.added, *added], folded.removed, places=places | fold)
        return Change(added, places=places)


def _by_ledger(spark: SparkSession, root: str, entry: Version, late: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Late rows of dropped days: those whose keys are new, and those that have been counted."""
    places = _places(late, "ledger", buckets)
    kept = entry.of("ledger", lambda d: d.where in places)
    known = _side(_scan(spark, root, "ledger", entry, kept).select(*SAMPLE_KEY), *kept)
    return late.join(known, list(SAMPLE_KEY), "left_anti"), late.join(known, list(SAMPLE_KEY), "left_semi")


def _with_late(old: DataFrame, new: DataFrame, late: list[Directory]) -> DataFrame:
    """Stored days with further values, those of the keys in ``late``; both have the sums before rounding."""
    total, n = F.sum(F.coalesce("_total", "sum_value")), F.sum("sample_count")
    both = old.join(_side(new.select(*DAY_KEY), *late), list(DAY_KEY), "left_semi").unionByName(new)
    return both.groupBy(*DAY_KEY).agg(
        half_up(ratio(total, n), 4).alias("avg_value"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), half_up(total, 4).alias("sum_value"), n.alias("sample_count"),
        F.max("unit").alias("unit"), total.alias("_total")).select(*_COLUMNS["summaries"])


def _counted(known: DataFrame) -> DataFrame:
    content = F.to_json(F.struct(*SAMPLE_COLUMNS))
    return rejects.rows(known, "store", F.col("seq"), F.lit("already counted"), content)


def upsert_into_tiers(spark: SparkSession, root: str, new: DataFrame, by_seq: bool = False) -> int:
    """Upsert samples of any age, last write wins: the new row, or with `by_seq` the one of the
    higher `seq`, for deliveries that may overtake each other.  Rows of summarised days
    replace their summaries, so a delivery that is repeated changes nothing.  Of a day whose raws
    were dropped, a sample with a new key is added to the summary, and one whose key is known goes
    to `rejected`."""
    _entry(spark, root, directories=False)
    return manifest.transact(spark, root, Delivery(spark, root, new, SEQ if by_seq else LAST).change)


def insert_into_tiers(spark: SparkSession, root: str, new: DataFrame) -> int:
    """Add the samples whose key is not stored yet, as the import of an export does."""
    _entry(spark, root, directories=False)
    return manifest.transact(spark, root, Delivery(spark, root, new, FIRST).change)


def upsert_samples(spark: SparkSession, root: str, new: DataFrame, by_seq: bool = False) -> int:
    """`upsert_into_tiers` that creates the store where there is none."""
    if current_version(spark, root) == 0:
        rows = latest_per_key(_valid(new)).select(*SAMPLE_COLUMNS)
        return publish(spark, root, rows, daily_summary(rows.filter(F.lit(False))))
    return upsert_into_tiers(spark, root, new, by_seq)


def publish_cut(spark: SparkSession, root: str, new_summaries: DataFrame, cut, tz: str) -> int:
    """Add summaries of newly expired days and, in the same version, the local day before
    which raw quantities no longer count.  The cut only moves forward, in one zone.

    Only the new days are written, however large both tiers are.
    """
    cut = as_date(cut)
    if "_total" not in new_summaries.columns:
        new_summaries = new_summaries.withColumn("_total", F.col("sum_value"))

    def build(entry: Version) -> Change:
        old = entry.settings
        if old["cut"] and (cut < as_date(old["cut"]) or tz != old["tz"]):
            raise ValueError(f"the cut is {old['cut']} in {old['tz']}; it cannot move to {cut} in {tz}")
        added = _write(spark, root, "summaries", new_summaries.select(*_COLUMNS["summaries"]), old["buckets"], delta=True, rule=LAST)
        fold = _in_the_way(entry, added)
        folded = _fold(spark, root, entry, fold) if fold else Change()
        return Change([*folded.added, *added], folded.removed, {"cut": str(cut), "tz": tz}, {d.where for d in added} | fold)

    _entry(spark, root, directories=False)
    return manifest.transact(spark, root, build)


def first_whole_day(month: str, tz: str) -> dt.date:
    """The first local day that lies wholly in a UTC month or after it."""
    start = dt.datetime.fromisoformat(f"{month}-01T00:00:00+00:00")
    day = start.date() - dt.timedelta(days=1)
    while day_start(day, tz) < start:
        day += dt.timedelta(days=1)
    return day


def drop_expired(spark: SparkSession, root: str) -> int:
    """Take the raw quantities of whole UTC months before the cut out of the store.  Their summaries
    remain, and the ledger takes the keys of all days that are no longer whole, so that late rows
    of these days are still merged, once each."""
    def build(entry: Version) -> Change | None:
        cut, tz, old = entry.settings["cut"], entry.settings["tz"], entry.settings["dropped_before"]
        if not cut:
            return None
        first = str(day_start(cut, tz))[:7]
        whole = first_whole_day(first, tz)
        quantities = _quantities(spark, entry.of("samples"))
        gone = entry.of("samples", lambda d: d.value("month") < first and d.value("metric_type") in quantities)
        if not gone:
            return None
        # The last of these days may end in the month that stays.
        touched = entry.of("samples", lambda d: d.value("month") <= first and d.value("metric_type") in quantities)
        raw = _merged(spark, root, "samples", entry, touched).filter(before_day("started_at", whole, tz))
        if old:
            raw = raw.filter(~before_day("started_at", old, tz))
        added = _write(spark, root, "ledger", raw.select(*SAMPLE_KEY), entry.settings["buckets"])
        return Change(added, set(gone), {"dropped_before": str(max(whole, as_date(old)) if old else whole)})

    _entry(spark, root, directories=False)
    return manifest.transact(spark, root, build)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete what the version in force does not refer to; returns the paths.

    Readers that opened an older version, and writers that have not committed, may still need them:
    run it when there are none.
    """
    entry = _entry(spark, root)
    used = {(d.tier, d.name) for d in entry.directories}
    gone = [f"{root}/{tier}/{name}" for tier in PARTITIONS for name, _ in manifest.names(spark, f"{root}/{tier}")
            if name.startswith("write=") and (tier, name.removeprefix("write=")) not in used]
    gone += [f"{root}/{manifest.MANIFESTS}/{name}" for name, _ in manifest.names(spark, f"{root}/{manifest.MANIFESTS}")
             if name != entry.settings["manifest"]]
    gone += [f"{root}/{manifest.LOG}/{n:012d}.json" for n in manifest.numbers(spark, root) if n != entry.number]
    for path in gone:
        manifest.remove(spark, path)
    return gone
