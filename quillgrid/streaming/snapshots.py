"""Repeated snapshots of one source: changes, freshness, latest version; and favourites as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRESH_SECONDS, STALE_SECONDS, CLIENT_SECONDS = 3600, 86400, 7 * 86400


#: A url that was not seen for so long is new again.
KEEP_SECONDS = 90 * 86400
#: Rows that come so much later than newer ones may be left out by a stream.
LATENESS = "1 day"


def changed_snapshots(snapshots: DataFrame, keep_seconds: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Snapshots ``(url, fetched_at, content_hash)`` whose hash differs from the one before of their url.

    A hash that comes back after another one is a change again. Of one time the least hash
    comes first. With ``keep_seconds``, a snapshot more than so much later than the one
    before is a change whatever its hash. ``initial`` (url, fetched_at, content_hash), the
    last snapshots known, one row a url, come before the first ones. Times without a zone
    are the session's.
    """
    w = Window.partitionBy("url").orderBy("fetched_at", "content_hash")
    before = {"_before": F.lag("content_hash").over(w), "_at": F.lag("fetched_at").over(w)}
    rows = snapshots
    if initial is not None:
        rows = rows.join(_known(initial), "url", "left")
        first = F.row_number().over(w) == 1
        before = {"_before": F.when(first, F.col("_known")).otherwise(before["_before"]), "_at": F.when(first, F.col("_known_at")).otherwise(before["_at"])}
    changed = ~F.col("content_hash").eqNullSafe(F.col("_before")) | F.col("_at").isNull()
    if keep_seconds is not None:
        changed |= F.unix_micros(F.col("fetched_at").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp")) > keep_seconds * 1_000_000
    return rows.withColumns(before).filter(changed).select(snapshots.columns)


def _known(initial: DataFrame) -> DataFrame:
    return initial.select("url", F.col("fetched_at").cast("timestamp").alias("_known_at"), F.col("content_hash").alias("_known"))


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _emit_changes(keep_micros: int):
    """A url's state is its last hash and time; it goes when the watermark is past the time it is kept."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["fetched_at", "content_hash"])
        times, hashes = _micros(rows["fetched_at"]), [None if pd.isna(h) else h for h in rows["content_hash"]]
        known = rows["_known_at"].iloc[0]
        at, last = state.get if state.exists else (None, None) if pd.isna(known) else (_micros(rows["_known_at"])[0], rows["_known"].iloc[0])
        keep = []
        for t, h in zip(times, hashes, strict=True):
            keep.append(at is None or h != last or t - at > keep_micros)
            at, last = (t, h) if at is None else (max(t, at), h)
        state.update((at, last))
        expires = (at + keep_micros) // 1000 + 1
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield rows[keep][["url", "fetched_at", "content_hash"]]

    return run


def changed_snapshots_stream(snapshots: DataFrame, keep_seconds: int = KEEP_SECONDS, initial: DataFrame | None = None, lateness: str = LATENESS) -> DataFrame:
    """The same for a stream whose rows of one url come in order: equal to the batch form.

    The state of a url leaves the store ``keep_seconds`` after its last snapshot, by event
    time, so that the store holds the urls of that time only. When a state goes does not
    matter for the result, as a row that late is a change with or without it. ``initial`` is
    joined to the rows, and is looked at where a url has no state: a url whose state has
    gone has an initial row that is older still.
    """
    rows = snapshots.select("url", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "content_hash").withWatermark("fetched_at", lateness)
    if initial is None:
        rows = rows.withColumns({"_known_at": F.lit(None).cast("timestamp"), "_known": F.lit(None).cast("string")})
    else:
        rows = rows.join(_known(initial), "url", "left")
    schema = "url string, fetched_at timestamp, content_hash string"
    return rows.groupBy("url").applyInPandasWithState(_emit_changes(keep_seconds * 1_000_000), schema, "at long, last string", "append", GroupStateTimeout.EventTimeTimeout)


def freshness(fetched_at: Column, as_of: Column) -> Column:
    """hit up to an hour, stale up to a day, else miss."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(fetched_at)
    return F.when(age <= FRESH_SECONDS, "hit").when(age <= STALE_SECONDS, "stale").otherwise("miss")


def client_copy_valid(fetched_at: Column, as_of: Column, version: Column, current: int = 1) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(fetched_at) <= CLIENT_SECONDS) & (version == current)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each url; of one time the greatest hash."""
    rest = [c for c in snapshots.columns if c != "url"]
    best = F.max_by(F.struct(*rest), F.struct("fetched_at", "content_hash")).alias("b")
    return snapshots.groupBy("url").agg(best).select("url", *[f"b.{c}" for c in rest])


#: After so many batches, buckets with many deltas are merged.
COMPACT_EVERY = 50
#: Folders by the hash of the url. A root keeps the number it was begun with.
BUCKETS = 64
#: A bucket is merged when its deltas have so large a share of the rows of its base.
MERGE_SHARE = 0.25


def upsert_latest(stream: DataFrame, root: str, checkpoint: str, compact_every: int = COMPACT_EVERY, buckets: int = BUCKETS):
    """A stream's writer that keeps the newest snapshot of each url under ``root``: a log-structured merge.

    A batch writes its own newest snapshots, by bucket, as a delta named by the batch, so
    that a batch that is run again replaces only itself, and nothing that other batches
    wrote is ever deleted. Every ``compact_every`` batches the buckets whose deltas have grown
    to ``MERGE_SHARE`` of their base get a new base beside the old one; the others keep
    theirs and their deltas. So a row that changes is written once as a delta, and on
    average some ``1 + 1 / MERGE_SHARE`` times in merges, however large the base is. Only
    then are the bases named, by a numbered pointer. A crash at any point leaves
    the last named bases and all deltas after them. Snapshots have no column ``bucket`` or ``batch``.
    """

    def step(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
        newest = latest_snapshots(batch).withColumn("bucket", bucket)
        newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/delta/batch={number}")
        if number % compact_every == compact_every - 1:
            compact_latest(batch.sparkSession, root, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _found(read, path: str) -> DataFrame | None:
    """What ``read`` reads, or nothing if there is no such path."""
    try:
        return read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


POINTER = "bucket int, at string, through int, n_rows long"


def _named_bases(spark: SparkSession, root: str) -> dict[int, Row]:
    """By bucket: the name of its base, the last batch in it, its number of rows. At most a row a bucket."""
    pointers = _found(spark.read.schema(f"{POINTER}, n int").json, f"{root}/pointer")
    if pointers is None:
        return {}
    newest = pointers.filter("at is not null").agg(F.max("n")).first()[0]
    return {r["bucket"]: r for r in pointers.filter((F.col("n") == newest) & F.col("at").isNotNull()).drop("n").collect()}


def _deltas(spark: SparkSession, root: str, bases: dict[int, Row], through: int | None) -> DataFrame | None:
    """The deltas that are in no base; the rest is left out by folder."""
    deltas = _found(spark.read.parquet, f"{root}/delta")
    if deltas is None or "bucket" not in deltas.columns:
        return None
    if bases:
        done = F.create_map(*[F.lit(v) for b, r in bases.items() for v in (b, r["through"])])
        deltas = deltas.filter(F.col("batch") > F.coalesce(F.try_element_at(done, F.col("bucket")), F.lit(-1)))
    return deltas if through is None else deltas.filter(F.col("batch") <= through)


def _merged(spark: SparkSession, root: str, bases: dict[int, Row], deltas: DataFrame | None) -> DataFrame | None:
    """The newest snapshot of each url in the given bases and deltas, with its ``bucket``."""
    rows = None if deltas is None else deltas.drop("batch")
    if bases:
        folders = [f"{root}/base/at={r['at']}/bucket={b}" for b, r in bases.items()]
        kept = spark.read.option("basePath", f"{root}/base").parquet(*folders).drop("at")
        if rows is None:
            return kept
        rows = kept.unionByName(rows)
    return None if rows is None else latest_snapshots(rows)


def compact_latest(spark: SparkSession, root: str, through: int, share: float = MERGE_SHARE) -> None:
    """Merges the buckets whose deltas, up to a batch, are many beside their base; then names all bases."""
    bases = _named_bases(spark, root)
    deltas = _deltas(spark, root, bases, through)
    grown = {} if deltas is None else {r["bucket"]: r["count"] for r in deltas.groupBy("bucket").count().collect()}
    due = [b for b, n in grown.items() if b not in bases or n >= share * bases[b]["n_rows"]]
    if not due:
        return
    at = f"{through}-{uuid.uuid4().hex}"
    rows = _merged(spark, root, {b: bases[b] for b in due if b in bases}, deltas.filter(F.col("bucket").isin(due)))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/base/at={at}")
    counts = spark.read.parquet(f"{root}/base/at={at}").groupBy("bucket").count().collect()
    named = [tuple(r) for b, r in bases.items() if b not in due] + [(r["bucket"], at, through, r["count"]) for r in counts]
    spark.createDataFrame(named, POINTER).coalesce(1).write.mode("overwrite").json(f"{root}/pointer/n={through}")


def read_latest(spark: SparkSession, root: str, through: int | None = None) -> DataFrame | None:
    """The newest snapshot of each url in bases and later deltas, or nothing before the first batch."""
    bases = _named_bases(spark, root)
    rows = _merged(spark, root, bases, _deltas(spark, root, bases, through))
    return None if rows is None else rows.drop("bucket")


FAVOURITE_KEY = ["artist_slug", "era_name", "base_name"]


def _fold_favourites(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    held = dict(zip(map(tuple, state.get[0]), state.get[1], strict=True)) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values(["ts", "action"], key=lambda c: c if c.name == "ts" else c != "toggle", kind="stable")
    for r in rows.itertuples(index=False):
        k = (r.artist_slug, r.era_name, r.base_name)
        if r.action == "clear":
            held = {}
        elif r.action == "remove" or k in held:
            held.pop(k, None)
        else:
            held[k] = r.ts.isoformat()
    state.update(([list(k) for k in held], list(held.values())))
    rows = [(key[0], *k, t) for k, t in held.items()] or [(key[0], None, None, None, None)]
    yield pd.DataFrame(rows, columns=["user_id", *FAVOURITE_KEY, "added_at"])


def favourites_stream(events: DataFrame) -> DataFrame:
    """Each user's favourites after every batch that touches them; the state is one user's set.

    A user whose set has become empty gives one row of nulls, so that a reader that keeps
    the last rows of each user drops the old ones.
    """
    schema = "user_id long, artist_slug string, era_name string, base_name string, added_at string"
    return events.groupBy("user_id").applyInPandasWithState(_fold_favourites, schema, "keys array<array<string>>, times array<string>", "update", GroupStateTimeout.NoTimeout)
