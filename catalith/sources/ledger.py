"""Write-once outputs, the catalogue registry, and ledgers of counts and runs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import SourceError, file_digests


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write a named output; an existing one is never replaced."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry with the rows of ``new`` (code, ...); a code that is there already, or twice in ``new``, fails."""
    twice = new.groupBy("code").count().where("count > 1").select("code")
    taken = new.join(registry, "code", "left_semi").select("code").union(twice).distinct()
    if codes := [r["code"] for r in taken.orderBy("code").limit(20).collect()]:
        raise SourceError(f"codes already in use: {', '.join(codes)}")
    return registry.unionByName(new, allowMissingColumns=True)


def counted_write(df: DataFrame, path: str, **metrics: Column) -> dict[str, int]:
    """Write a named output as ``write_once`` does and return its rows and ``metrics`` (aggregates), gathered in the very write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]).write.mode("errorifexists").parquet(path)
    return seen.get


class Publication:
    """Tables under one folder that are published by commit files; what no commit file names is not there.

    A load writes its tables to a folder of its own, ``load-<id>``, and is published by one file, ``commits/<number>.json``,
    which is put in place under a new number by one renaming that never replaces. Until then readers see nothing of it, after
    that all of it. A load that fails or dies leaves a folder that no commit names: no later load uses
    it, and ``recover`` deletes it. Loads at the same time are put in order by the number; one whose table another
    has published meanwhile fails.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, *parts: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.target, *parts]))

    def _names(self, *parts: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(*parts))) if self.fs.exists(self.path(*parts)) else []

    def commits(self) -> list[dict]:
        """What was published, in order: load, and rows of each table."""
        out = []
        for name in (n for n in self._names("commits") if n.endswith(".json")):
            stream = self.fs.open(self.path("commits", name))
            try:
                out.append(json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def tables(self) -> dict[str, str]:
        """Paths of the published tables by name."""
        return {name: f"{self.target}/{c['load']}/{name}" for c in self.commits() for name in c["tables"]}

    def read(self, name: str) -> DataFrame:
        """A published table."""
        tables = self.tables()
        if name not in tables:
            raise SourceError(f"{name} is not published in {self.target}")
        return self.spark.read.parquet(tables[name])

    def _commit(self, load: str, counts: Mapping[str, int]) -> None:
        mine = self.path(load, "commit.json")
        stream = self.fs.create(mine, False)
        try:
            stream.write(bytearray(json.dumps({"load": load, "tables": dict(counts)}, sort_keys=True).encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path("commits"))
        keep = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        while True:
            if taken := sorted(set(self.tables()) & set(counts)):
                raise SourceError(f"already published: {', '.join(taken)}; nothing was")
            try:
                self.context.rename(mine, self.path("commits", f"{len(self._names('commits')):010}.json"), keep)
                return
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                    raise  # else another load took the number: look again

    def load(self, staged: Mapping[str, tuple[DataFrame, int]]) -> dict[str, int]:
        """All or nothing: write every table (with its expected rows), compare the counts that the writes gathered, and publish all by one commit."""
        if taken := sorted(set(self.tables()) & set(staged)):
            raise SourceError(f"already published: {', '.join(taken)}; nothing was")
        load, counts = f"load-{uuid.uuid4().hex}", {}
        try:
            for name, (df, expected) in staged.items():
                counts[name] = counted_write(df, f"{self.target}/{load}/{name}")["rows"]
                if counts[name] != expected:
                    raise SourceError(f"{name}: {counts[name]} rows instead of {expected}; nothing was published")
            self._commit(load, counts)
        except Exception:
            self.fs.delete(self.path(load), True)
            raise
        return counts

    def recover(self) -> list[str]:
        """Delete what loads left that died before their commit, and return their names; not to be called while a load runs."""
        kept = {c["load"] for c in self.commits()}
        left = [n for n in self._names() if n.startswith("load-") and n not in kept]
        for n in left:
            self.fs.delete(self.path(n), True)
        return left


def load_all(staged: Mapping[str, tuple[DataFrame, int]], target: str) -> dict[str, int]:
    """Publish tables (each with its expected rows) in ``target``, all or none; see ``Publication``."""
    return Publication(next(iter(staged.values()))[0].sparkSession, target).load(staged)


def manifest(spark: SparkSession, run: str, inputs: Mapping[str, str], settings: Mapping[str, object], counts: Mapping[str, int], digests: Mapping[str, str]) -> DataFrame:
    """Ledger rows (run, kind, name, value) of all that a run's results depend on.

    Inputs by path, with bytes and SHA-256 of each file (computed where the files are), resolved
    settings as JSON, and the counts and digests of what was made. Rows only: append them, or ``write_once``.
    """
    given = [(run, "setting", k, json.dumps(v, sort_keys=True)) for k, v in sorted(settings.items())]
    given += [(run, "count", k, str(int(v))) for k, v in sorted(counts.items())] + [(run, "digest", k, v) for k, v in sorted(digests.items())]
    out = spark.createDataFrame(given, "run string, kind string, name string, value string")
    for name, path in sorted(inputs.items()):
        files = file_digests(spark, path)
        value = F.to_json(F.struct(F.element_at(F.split("source_file", "/"), -1).alias("file"), "n_bytes", "sha256"))
        out = out.unionByName(files.select(F.lit(run).alias("run"), F.lit("input").alias("kind"), F.lit(name).alias("name"), value.alias("value")))
    return out


def stage_counts(spark: SparkSession, run: str, stage: str, counts: Mapping[str, int]) -> DataFrame:
    """Ledger rows (run, stage, category, count)."""
    rows = [(run, stage, k, int(v)) for k, v in sorted(counts.items())]
    return spark.createDataFrame(rows, "run string, stage string, category string, count long")


def seal(ledger: DataFrame, entry: DataFrame) -> DataFrame:
    """Ledger with ``entry`` (sample, kind, digest); a (sample, kind) is sealed only once, and never without a digest."""
    if not entry.where("digest is null or digest = ''").isEmpty():
        raise SourceError("a stage is sealed only with its digest")
    if not entry.join(ledger, ["sample", "kind"], "left_semi").isEmpty():
        raise SourceError("the stage is sealed already")
    return ledger.unionByName(entry)


def latest_status(status: DataFrame) -> DataFrame:
    """run, status, at: the last of each run's append-only (run, status, at) rows; ties go to the later status name in order."""
    return status.groupBy("run").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def complete_runs(status: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs (run, ...) of runs whose last status is complete; partial ones never count."""
    done = latest_status(status).where("status = 'complete'").select("run")
    return outputs.join(done, "run", "left_semi")
