"""Keyed updates, protected replacement, snapshots and logs over Parquet tables.

Parquet has no MERGE: an update is a pure function from the stored table and a batch to the new table. The result is
staged beside the target and then swapped in, so a failed write leaves the old table in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.functions.ordered import dense_position
from traceframe.session import checkpointed

# ----------------------------------------------------------------- pure updates


def last_per_key(batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key, the last by `seq`; combines map-side, so a repeated key does not gather."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def upserted(stored: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str, update: Sequence[str] | None = None, stamp: Column | None = None) -> DataFrame:
    """Stored table after inserting or updating a batch; `update` lists the columns a hit overwrites (default all)."""
    cols = [c for c in stored.columns if c not in keys and c != "updated_at"]
    update = list(update) if update is not None else cols
    new = last_per_key(batch, keys, seq).select(*keys, F.struct(*cols).alias("_n"))
    old = stored.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("_o"))
    j = old.join(new, list(keys), "full_outer")
    hit = F.col("_n").isNotNull()
    out = [
        F.when(hit & (F.col("_o").isNull() | F.lit(c in update)), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c)
        for c in cols
    ]
    if "updated_at" in stored.columns:
        out.append(F.when(hit, stamp if stamp is not None else F.current_timestamp()).otherwise(F.col("_o.updated_at")).alias("updated_at"))
    return j.select(*keys, *out).select(*stored.columns)


def partially_updated(stored: DataFrame, payload: DataFrame, keys: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """Payload value, else stored value, else default, for every key on either side."""
    p = payload.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in defaults])
    j = stored.join(p, list(keys), "full_outer")
    return j.select(*keys, *[F.coalesce(f"_p_{c}", c, d).alias(c) for c, d in defaults.items()])


def protected_replace(
    stored: DataFrame, batch: DataFrame, owner: str, keys: Sequence[str], seq: str, replace: bool
) -> tuple[DataFrame, DataFrame]:
    """(new table, counts stored / deleted / skipped per owner in the batch).

    Authored rows are never displaced by traced ones: not the stored ones, and not those earlier in the same batch.
    With `replace` the owner's stored traced rows go first.
    """
    ident = [owner, *keys]
    authored = F.col("provenance") == "authored"
    guard = stored.where(authored).select(*ident, F.lit(True).alias("_kept"))
    first_authored = batch.where(authored).groupBy(*ident).agg(F.min(seq).alias("_first"))
    b = batch.join(guard, ident, "left").join(first_authored, ident, "left")
    skipped = ~authored & (F.coalesce("_kept", F.lit(False)) | F.coalesce(F.col(seq) > F.col("_first"), F.lit(False)))
    b = b.withColumn("_skip", skipped).drop("_kept", "_first")
    accepted = b.where(~F.col("_skip")).drop("_skip")
    new = last_per_key(accepted, ident, seq)
    owners = batch.select(owner).distinct()
    gone = stored.where(~authored).join(owners, owner, "left_semi") if replace else stored.limit(0)
    kept = stored.join(gone.select(*ident), ident, "left_anti") if replace else stored
    table = kept.join(new.select(*ident), ident, "left_anti").unionByName(new.select(*stored.columns))
    counts = (
        owners.join(new.groupBy(owner).agg(F.count(F.lit(1)).alias("stored")), owner, "left")
        .join(gone.groupBy(owner).agg(F.count(F.lit(1)).alias("deleted")), owner, "left")
        .join(b.groupBy(owner).agg(F.count_if("_skip").alias("skipped")), owner, "left")
        .select(owner, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("stored", "deleted", "skipped")])
    )
    return table, counts


def without_matching(stored: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(table without the matching rows, number of deleted rows)."""
    hit = F.coalesce(predicate, F.lit(False))
    return stored.where(~hit), stored.agg(F.count_if(hit).alias("deleted"))


def rebuilt_for_owner(stored: DataFrame, recomputed: DataFrame, owner: str) -> DataFrame:
    """Stored table with everything of the recomputed owners replaced; keys that disappeared vanish."""
    owners = recomputed.select(owner).distinct()
    return stored.join(owners, owner, "left_anti").unionByName(recomputed.select(*stored.columns))


def plausibility(counts: DataFrame, previous: DataFrame, primary: Sequence[str], with_raw: str | None = None) -> DataFrame:
    """Reasons a snapshot must not be filed: empty primary tables, no raw paths, tables that shrank.

    counts(table, rows), previous(table, rows): one row per table. `with_raw` names the count of rows with raw data.
    """
    spark = counts.sparkSession
    must = spark.createDataFrame([(t,) for t in primary], "table STRING")
    empty = must.join(counts, "table", "left").where(F.coalesce("rows", F.lit(0)) == 0).select("table", F.lit("empty").alias("problem"))
    shrunk = (
        previous.select("table", F.col("rows").alias("was"))
        .join(counts, "table", "left")
        .where(F.coalesce("rows", F.lit(0)) < F.col("was"))
        .select("table", F.lit("shrank").alias("problem"))
    )
    out = empty.unionByName(shrunk)
    if with_raw is not None:
        none = counts.where((F.col("table") == with_raw) & (F.col("rows") == 0)).select("table", F.lit("no_raw_paths").alias("problem"))
        out = out.unionByName(none)
    return out


def restored_columns(payload: DataFrame, target_columns: Sequence[str], generated: Sequence[str] = (), inject: dict[str, Column] | None = None) -> DataFrame:
    """Payload columns the target has, without generated keys, plus injected keys."""
    inject = inject or {}
    keep = [c for c in payload.columns if c in target_columns and c not in generated and c not in inject]
    return payload.select(*keep, *[v.alias(k) for k, v in inject.items()])


def slug(label: Column) -> Column:
    """Lower-case label of letters, digits and single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def lean_export(rows: DataFrame, kinds: Sequence[str], ids: DataFrame, id_col: str, keep: Sequence[str]) -> DataFrame:
    """Rows of the wanted kinds and ids with only the kept measurement keys."""
    hit = rows.where(F.col("kind").isin(list(kinds))).join(ids.select(id_col).distinct(), id_col, "left_semi")
    return hit.withColumn("measurements", F.struct(*[F.col(f"measurements.{k}") for k in keep]))


def union_of_columns(*frames: DataFrame) -> DataFrame:
    """Rows of all frames: the first frame's columns, then later extras."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --------------------------------------------------------------------- storage


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def swap_in(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write the new table beside the old one, then take its place. `df` may read the old table."""
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    staged, old = f"{path}.staged-{tag}", f"{path}.old-{tag}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(staged)
    target, fs = _path(spark, path)
    if fs.exists(target):
        fs.rename(target, _path(spark, old)[0])
    if not fs.rename(_path(spark, staged)[0], target):
        raise OSError(f"could not move {staged} to {path}")
    if exists(spark, old):
        fs.delete(_path(spark, old)[0], True)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions `df` holds. The rows are staged first, so `df` may read `path`."""
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    p, fs = _path(spark, staged)
    fs.delete(p, True)


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], seq: str, partition: str, update: Sequence[str] | None = None) -> None:
    """Upsert into a table partitioned by `partition` (one of the keys); untouched partitions are not read or written."""
    if not exists(spark, path):
        overwrite_partitions(last_per_key(batch, keys, seq), path, [partition])
        return
    stored = spark.read.parquet(path)
    touched = stored.join(batch.select(partition).distinct(), partition, "left_semi")
    overwrite_partitions(upserted(touched, batch, keys, seq, update), path, [partition])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for named tables, as one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, stamp: str, primary: Sequence[str]) -> None:
    """File one snapshot: refuses an existing stamp and an implausible state; the manifest is written last."""
    target = f"{root}/snapshots/stamp={stamp}"
    if exists(spark, target):
        raise FileExistsError(f"{target} already exists; snapshots are never rewritten")
    counts = table_counts(tables).cache()
    manifests = f"{root}/manifest"
    empty = spark.createDataFrame([], "table STRING, rows BIGINT")
    previous = latest_manifest(spark, root) if exists(spark, manifests) else empty
    problems = plausibility(counts, previous, primary).collect()  # one row per table at most
    if problems:
        raise ValueError("; ".join(f"{p['table']}: {p['problem']}" for p in problems))
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
    counts.withColumn("stamp", F.lit(stamp)).write.mode("append").partitionBy("stamp").parquet(manifests)
    counts.unpersist()


def latest_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(table, rows) of the newest filed snapshot."""
    m = spark.read.schema("table STRING, rows BIGINT, stamp STRING").parquet(f"{root}/manifest")
    last = m.agg(F.max("stamp").alias("stamp"))
    return m.join(F.broadcast(last.limit(1)), "stamp", "left_semi").select("table", "rows")


def restore_snapshot(
    spark: SparkSession, root: str, stamp: str, parents: dict[str, tuple[str, Sequence[str]]], primaries: dict[str, str], apply: bool, replace: bool
) -> DataFrame:
    """Restore a snapshot into target paths: parents {name: (path, keys)} are merged first, primaries {name: path}
    are written whole. An occupied primary is refused without `replace`. Gives (table, rows); writes only on `apply`."""
    source = f"{root}/snapshots/stamp={stamp}"
    counts = table_counts({n: spark.read.parquet(f"{source}/{n}") for n in [*parents, *primaries]})
    if not apply:
        return counts
    occupied = [n for n, p in primaries.items() if exists(spark, p) and not spark.read.parquet(p).isEmpty()]
    if occupied and not replace:
        raise ValueError(f"target tables are occupied: {', '.join(sorted(occupied))}")
    for name, (path, keys) in parents.items():
        rows = spark.read.parquet(f"{source}/{name}")
        if exists(spark, path):
            stored = spark.read.parquet(path)
            rows = upserted(stored, restored_columns(rows, stored.columns).withColumn("_seq", F.lit(0)), keys, "_seq")
        swap_in(rows, path)
    for name, path in primaries.items():
        rows = spark.read.parquet(f"{source}/{name}")
        if exists(spark, path):
            rows = restored_columns(rows, spark.read.parquet(path).columns)
        swap_in(rows, path)
    return counts


def with_new_keys(payload: dict[str, DataFrame], stores: dict[str, DataFrame], keys: dict[str, str], links: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """Payload tables with their generated integer keys made anew behind those of the stores, and references carried along.

    keys {table: key column}, in the order of references, parents first; links {table: {column: parent table}}. New keys follow
    the order of the old ones, from the store's largest key on. A reference to a row that is not in the payload becomes null.
    """
    out: dict[str, DataFrame] = {}
    maps: dict[str, DataFrame] = {}
    for name, df in payload.items():
        for column, parent in links.get(name, {}).items():
            known = maps[parent].select(F.col("old").alias(column), F.col("new").alias("_new"))
            df = df.join(known, column, "left").withColumn(column, F.col("_new")).drop("_new")
        if name in keys:
            key = keys[name]
            last = stores[name].agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("_last"))  # one row
            old = df.select(F.col(key).cast("bigint").alias("old")).where("old IS NOT NULL").distinct()
            ranked = dense_position(old, [], ["old"], F.floor(F.col("old") / (1 << 16)), "_at", 1)
            maps[name] = checkpointed(ranked.crossJoin(F.broadcast(last)).select("old", (F.col("_at") + F.col("_last")).alias("new")))
            df = df.join(maps[name].withColumnRenamed("old", key), key).withColumn(key, F.col("new")).drop("new")
        out[name] = df
    return out


def append_run(spark: SparkSession, root: str, artifacts: DataFrame, stamp: str, label: str) -> None:
    """File the artifacts of one run under (stamp, slugged label); empty or repeated names and existing runs are refused."""
    checked = artifacts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("body")).alias("short"))
    flaws = checked.agg(
        F.count(F.lit(1)).alias("names"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.coalesce("short", F.lit(0)) == 0).alias("empty")
    ).first()
    if flaws["names"] == 0 or flaws["twice"] or flaws["empty"]:
        raise ValueError(f"artifacts refused: {flaws.asDict()}")
    run = artifacts.select(F.lit(stamp).alias("stamp"), slug(F.lit(label)).alias("label"), "name", "body")
    index = f"{root}/index"
    key = run.select("stamp", "label").limit(1)
    if exists(spark, index) and not spark.read.parquet(index).join(key, ["stamp", "label"], "left_semi").isEmpty():
        raise FileExistsError(f"run {stamp}/{label} is already filed")
    run.write.mode("append").partitionBy("stamp", "label").parquet(f"{root}/runs")
    key.withColumn("artifacts", F.lit(flaws["names"])).write.mode("append").parquet(index)


def delete_rows(spark: SparkSession, path: str, predicate: Column) -> int:
    """Delete the matching rows of a table and say how many went."""
    kept, deleted = without_matching(spark.read.parquet(path), predicate)
    n = deleted.first()["deleted"]
    if n:
        swap_in(kept, path)
    return n


def reseed(df: DataFrame, path: str) -> None:
    """Replace a table by a full new content."""
    swap_in(df, path)
