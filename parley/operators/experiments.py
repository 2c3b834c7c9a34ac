"""Experiment grids, identities, resumption and paired comparisons."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.batches import put_file


@dataclass
class Config:
    """What an experiment run needs; ``from_dict`` also takes the older flat form."""

    dataset: str = "default"
    subset: str | None = None
    parsers: list[str] = field(default_factory=lambda: ["rules"])
    annotators: list[str] = field(default_factory=lambda: ["keyword"])
    fine_tunings: list[str | None] = field(default_factory=lambda: [None])
    context_mode: str = "interval"
    context_volleys: int = 3
    class_structure: str = "tiered"

    @classmethod
    def from_dict(cls, raw: dict) -> Config:
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        for old, new in (("parser", "parsers"), ("annotator", "annotators"), ("fine_tuning", "fine_tunings")):
            if old in raw and new not in known:
                known[new] = [raw[old]]
        return cls(**known)

    def problems(self) -> list[str]:
        from parley.operators.context import MODES

        found = [f"no {x}" for x in ("parsers", "annotators", "fine_tunings") if not getattr(self, x)]
        if self.context_mode not in MODES:
            found.append(f"unknown context mode: {self.context_mode}")
        if self.class_structure not in ("tiered", "flat"):
            found.append(f"unknown class structure: {self.class_structure}")
        if self.context_volleys < 0:
            found.append("context_volleys is negative")
        return found


def experiment_id(*parts: Column) -> Column:
    """Eight hex digits of the md5 over all settings, so that settings that differ never share an id by design."""
    return F.substring(F.md5(F.concat_ws("_", *[F.coalesce(p, F.lit("none")) for p in parts])), 1, 8)


def grid(spark: SparkSession, config: Config) -> DataFrame:
    """Every combination of parser, annotator and fine-tuning with its id."""
    one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    both = one(config.parsers, "parser").crossJoin(one(config.annotators, "annotator")).crossJoin(one(config.fine_tunings, "fine_tuning"))
    settings = [F.lit(config.context_mode), F.lit(str(config.context_volleys)), F.lit(config.class_structure)]
    return both.withColumn("experiment_id", experiment_id(F.col("parser"), F.col("annotator"), F.col("fine_tuning"), *settings))


def grid_of(runs: DataFrame, settings: list[str]) -> DataFrame:
    """Every combination of the values that ``settings`` columns take in a table of runs, with its id."""
    out = runs.agg(*[F.collect_set(F.struct(c)).alias(c) for c in settings])  # names of models, not rows of data
    for c in settings:
        out = out.withColumn(c, F.explode(c)).withColumn(c, F.col(c)[c])
    return out.select(*settings, experiment_id(*[F.col(c) for c in settings]).alias("experiment_id"))


def artifact_name(dataset: str, subset: str | None, structure: str, parser: str, annotator: str, mode: str, volleys: int) -> str:
    slug = lambda m: m.rsplit("/", 1)[-1]
    return "_".join([dataset, subset or "all", structure, slug(parser), slug(annotator), mode, str(volleys)])


def fine_tuning_pairs(results: DataFrame, metric: str) -> DataFrame:
    """Baseline and fine-tuned runs of the same parser and annotator with the change of a metric."""
    base = results.filter(F.col("fine_tuning").isNull()).select("parser", "annotator", F.col("experiment_id").alias("base_id"), F.col(metric).alias("base"))
    tuned = results.filter(F.col("fine_tuning").isNotNull()).select("parser", "annotator", "fine_tuning", F.col("experiment_id").alias("tuned_id"), F.col(metric).alias("tuned"))
    return base.join(tuned, ["parser", "annotator"]).withColumn("delta", F.col("tuned") - F.col("base"))


def mean_improvement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"))


def run_all(experiments: list[dict], done: set[str], run) -> dict[str, dict]:
    """Run what is not done yet, one experiment (itself a set of Spark jobs) after another; a failure is recorded, not fatal."""
    out = {}
    for e in experiments:
        if e["experiment_id"] in done:
            continue
        try:
            out[e["experiment_id"]] = {"success": True, "result": run(e)}
        except Exception as error:  # noqa: BLE001 one failed experiment must not end the others
            out[e["experiment_id"]] = {"success": False, "error": str(error)}
    return out


def progress(spark: SparkSession, path: str) -> dict[str, dict]:
    """What is known of the runs under ``path``, by experiment_id: state (running, done, failed), error and seconds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    rows = spark.read.schema("experiment_id string, state string, error string, seconds double").json(path).collect()  # one row a run
    return {r["experiment_id"]: r.asDict() for r in rows}


def run_parallel(spark: SparkSession, experiments: list[dict], run: Callable[[dict], object], path: str, max_parallel_jobs: int = 2) -> dict[str, dict]:
    """``run_all`` with ``max_parallel_jobs`` experiments at a time, each with a job group of its own.

    State is kept under ``path``, on a file system that outlives the driver: what is done there is not run again, what was
    running when a driver ended is. A run that fails cancels the jobs that it still has, and no other's.
    """
    done = {e for e, p in progress(spark, path).items() if p["state"] == "done"}
    left = [e for e in experiments if e["experiment_id"] not in done]
    sc = spark.sparkContext

    def one(e: dict) -> dict:
        name, began = e["experiment_id"], time.time()
        group = f"experiment-{name}-{uuid.uuid4().hex[:8]}"
        say = lambda state, error=None: put_file(spark, f"{path}/{name}.json", json.dumps({"experiment_id": name, "state": state, "error": error, "seconds": round(time.time() - began, 3)}))
        sc.setJobGroup(group, f"experiment {name}", interruptOnCancel=True)
        say("running")
        try:
            result = run(e)
        except Exception as error:  # noqa: BLE001 one failed experiment must not end the others
            sc.cancelJobGroup(group)
            say("failed", str(error)[:2000])
            return {"success": False, "error": str(error)}
        say("done")
        return {"success": True, "result": result}

    with ThreadPoolExecutor(max_workers=max(1, max_parallel_jobs)) as pool:
        runs = {e["experiment_id"]: pool.submit(inheritable_thread_target(spark)(one), e) for e in left}
        return {name: f.result() for name, f in runs.items()}


def evaluate(methods: list[str], known: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The tables of the named evaluations; a name that is not known is an error before anything runs."""
    unknown = [m for m in methods if m not in known]
    if unknown:
        raise ValueError(f"unknown evaluations: {', '.join(unknown)}; known: {', '.join(sorted(known))}")
    return {m: known[m]() for m in methods}


def save_checkpoint(path: str, config: Config, completed: list[str]) -> None:
    with open(path, "w") as f:
        json.dump({"config": asdict(config), "completed": sorted(completed)}, f)


def load_checkpoint(path: str) -> set[str]:
    try:
        with open(path) as f:
            return set(json.load(f)["completed"])
    except FileNotFoundError:
        return set()
