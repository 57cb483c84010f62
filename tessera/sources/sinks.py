"""Sinks: versioned tables with idempotent upserts and a run audit, and the exports."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.udfs import countries
from tessera.operators.ledger import canonical
from tessera.schemas import KEYS, TABLES


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key is not new, and the new rows."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


class Store:
    """Tables as Parquet versions below a folder; a pointer names the current version.

    A new version is written whole and becomes current with one small write at the end, so
    readers see the old or the new one, and a failed run leaves the old.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self, table: str) -> str | None:
        """The last version that was finished: pointers are only ever added, so there is always one to read."""
        fs, p = self._fs(f"{self.folder}/{table}/_pointers")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return names[-1] if names else None

    def read(self, table: str) -> DataFrame:
        """The current version; an empty table where there is none."""
        version = self.version(table)
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{table}/{version}") if version else self.spark.createDataFrame([], TABLES[table])

    def write(self, table: str, df: DataFrame) -> str:
        version = f"v-{datetime.now(UTC):%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/{table}/{version}")
        fs, p = self._fs(f"{self.folder}/{table}/_pointers/{version}")
        fs.mkdirs(p)
        return version

    def upsert(self, table: str, new: DataFrame, order: str | None = None) -> tuple[int, int]:
        """Insert or replace by natural key.  Returns (inserted, updated).

        Of equal keys the last in ``order`` wins; without an order the largest row, so that reruns agree.
        """
        keys = list(KEYS[table])
        old = self.read(table)
        others = [c for c in new.columns if c not in keys and c != order]
        last = F.col(order) if order else F.to_json(F.struct(*others))
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*others), last).alias("_r")).select(*keys, "_r.*")
        new = new.select(*old.columns)
        held = old.select(*keys, F.lit(True).alias("_held"))
        counts = new.select(*keys).join(held, keys, "left").agg(F.count("*").alias("n"), F.count("_held").alias("u")).first()
        self.write(table, merged(old, new, keys))
        return counts["n"] - counts["u"], counts["u"]

    def _log(self, run: dict) -> None:
        self.spark.createDataFrame([tuple(run.values())], TABLES["ingestion_runs"]).coalesce(1).write.mode("append").parquet(f"{self.folder}/ingestion_runs/log")

    def runs(self) -> DataFrame:
        """The last state of every run; one that never ended is still running."""
        log = self.spark.read.schema(TABLES["ingestion_runs"]).parquet(f"{self.folder}/ingestion_runs/log")
        rest = [c for c in log.columns if c != "run_id"]
        last = F.max_by(F.struct(*rest), F.coalesce("completed_at", F.timestamp_seconds(F.lit(0))))
        return log.groupBy("run_id").agg(last.alias("r")).select("run_id", "r.*")

    def ingest(self, table: str, new: DataFrame, source: str, query: str) -> dict:
        """An upsert with its audit rows: running as it begins, then completed with counts or failed with the error."""
        run = {"run_id": uuid.uuid4().hex, "source": source, "query": query, "status": "running", "error": None, "started_at": datetime.now(UTC), "completed_at": None, "total_found": None, "fetched": None, "inserted": None, "updated": None}
        self._log(run)
        try:
            run["inserted"], run["updated"] = self.upsert(table, new)
            run["status"], run["fetched"] = "completed", run["inserted"] + run["updated"]
        except Exception as e:
            run["status"], run["error"] = "failed", str(e)[:500]
            raise
        finally:
            run["completed_at"] = datetime.now(UTC)
            self._log(run)
        return run

    def ingest_batches(self, table: str, new: DataFrame, source: str, query: str, batch: Column, batches: int) -> dict:
        """Like ``ingest`` in several commits: rows are dealt to batches by a column, and a crash keeps the batches before."""
        totals = {"inserted": 0, "updated": 0}
        for i in range(batches):
            run = self.ingest(table, new.where(F.pmod(batch, F.lit(batches)) == i), source, f"{query} [{i + 1}/{batches}]")
            totals = {k: totals[k] + run[k] for k in totals}
        return totals


def canonical_countries(trials: DataFrame) -> DataFrame:
    """Trials with their countries in canonical form, first seen first."""
    return trials.withColumn("countries", countries("countries"))


def stale_embeddings(embeddings: DataFrame, changed: DataFrame) -> DataFrame:
    """Embeddings without those of documents whose title or abstract changed (document_id)."""
    return embeddings.join(changed.select("document_id").distinct(), "document_id", "left_anti")


def changed_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Natural keys of documents whose title or abstract differs."""
    keys = list(KEYS["documents"])
    before = old.select(*keys, F.col("title").alias("_t"), F.col("abstract").alias("_a"))
    return new.join(before, keys).where(~F.col("title").eqNullSafe(F.col("_t")) | ~F.col("abstract").eqNullSafe(F.col("_a"))).select(*keys)


def graph_snapshot(entities: DataFrame, edges: DataFrame, path: str, limit: int | None = None) -> None:
    """Entities by kind and name, edges by confidence: JSON lines."""
    entities.orderBy("kind", "name").write.mode("overwrite").json(f"{path}/entities")
    ordered = edges.orderBy(F.desc("confidence"), "subject", "predicate", "object")
    (ordered.limit(limit) if limit else ordered).write.mode("overwrite").json(f"{path}/edges")


def licensed_release(frames: dict[str, DataFrame], restricted: Column, path: str) -> None:
    """Each table twice: what anyone may use, and what only the restricted release holds."""
    for name, df in frames.items():
        df.where(~restricted).write.mode("overwrite").json(f"{path}/main/{name}")
        df.where(restricted).write.mode("overwrite").json(f"{path}/restricted/{name}")


def flat_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by semicolons."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def triples_tsv(edges: DataFrame, path: str) -> None:
    edges.select("subject", "predicate", "object").write.mode("overwrite").option("sep", "\t").csv(path)


def differential_jsonl(results: DataFrame, path: str) -> None:
    """Results of usable comparisons only (two samples or more on either side)."""
    results.where("n_case >= 2 AND n_control >= 2").write.mode("overwrite").json(path)


def markdown(df: DataFrame, limit: int = 50) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    text = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", r"\|")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(text(v) for v in r)} |\n" for r in rows)


def seal_json(record: dict) -> tuple[str, str]:
    """Canonical JSON and its SHA-256."""
    import hashlib

    body = canonical({k: v for k, v in record.items() if k != "sha256"})
    return body, hashlib.sha256(body.encode()).hexdigest()


def ingest_kept(store: Store, table: str, rows: DataFrame, rules: dict[str, Column], source: str, query: str) -> tuple[dict, DataFrame]:
    """Ingest the rows that pass all rules; what each rule, the first that fails, left out: (run, rows (reason, n))."""
    failed = F.coalesce(*[F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)) for name, keep in rules.items()])
    told = rows.withColumn("_reason", failed)
    run = store.ingest(table, told.where("_reason IS NULL").drop("_reason"), source, query)
    return run, told.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


class IndexCache:
    """Vectors of a store by (model, scope), kept in memory for as long as their table's version is the current one."""

    def __init__(self, store: Store) -> None:
        self.store, self._held = store, {}

    def get(self, model: str, scope: str) -> DataFrame:
        version = self.store.version("embeddings")
        held = self._held.get((model, scope))
        if held is None or held[0] != version:
            if held is not None:
                held[1].unpersist()
            vectors = self.store.read("embeddings").where((F.col("model") == model) & (F.col("scope") == scope)).select("document_id", "vector")
            self._held[model, scope] = (version, vectors.cache())
        return self._held[model, scope][1]
