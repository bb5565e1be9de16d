"""The ten steps from sources to a trained baseline, each read from and written to a table."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, eda, generate, learning, quality, review, rewrite, sampling
from ..sources import collect
from ..sources.tables import copy_table, exists, read_table, source_file_name, write_table
from . import report as reports
from .config import Folders, with_defaults

ROW_ID = "_row_id"
STOPPED, DONE = 2, 0


def numbered(df: DataFrame) -> DataFrame:
    """Row numbers in the order of the file, unlike each other also for equal rows, for tables without any."""
    return df if ROW_ID in df.columns else collect.number_rows(df, ROW_ID)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Review results with the order in which they count: by time stamp, then by what was decided, never by how the files are split."""
    df = read_table(spark, path)
    by = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in ("review_timestamp", "review_status", "human_label")]
    return df.withColumn("_order", F.struct(*by))


def collect_step(spark: SparkSession, config: dict, folders: Folders) -> None:
    c = config["collection"]
    named: dict[str, list[DataFrame]] = {}
    for s in c["sources"]:
        named.setdefault(s["name"], []).append(collect.collect_source(spark, s))
    frames = []
    for name, parts in named.items():  # a table a source, before any cap
        path = folders.path("raw/sources", source_file_name(name))
        write_table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), path)
        frames.append(read_table(spark, path))
    caps = {s["name"]: s.get("max_rows") or c["max_rows_per_source"] for s in c["sources"]}
    write_table(collect.merge(frames, c["max_merged_rows"], caps).drop(ROW_ID), folders.raw)  # numbers of a source aren't those of the union
    reports.write(spark, folders.path("reports", "data_summary.md"), eda.markdown(eda.report(read_table(spark, folders.raw))))


def rewrite_step(spark: SparkSession, config: dict, folders: Folders) -> None:
    if not config["rewrite"].get("enabled", True):
        copy_table(spark, folders.raw, folders.rewritten)
        return
    c = config["rewrite"]
    o = c.get("options") or rewrite.RewriteOptions()
    mode = c.get("mode") or ("llm" if c.get("service") else "rule")
    made = rewrite.run(numbered(read_table(spark, folders.raw)), replace(o, mode=mode), generate.generator(c.get("service"), mode))
    write_table(made, folders.rewritten)


def quality_step(spark: SparkSession, config: dict, folders: Folders) -> None:
    """The configured strategy; the chooser is for callers who ask for it."""
    c = config["quality"]
    o = quality.QualityOptions(duplicate_subset=tuple(c["duplicate_subset"]), iqr_k=c["iqr_k"])
    df = numbered(read_table(spark, folders.rewritten))
    clean = quality.fix(df, quality.Strategy(c["missing"], c["duplicates"], c["outliers"]), o)
    write_table(clean, folders.clean)
    reports.write(spark, folders.path("reports", "quality.md"), "# Quality\n\n" + reports.table(quality.compare(df, read_table(spark, folders.clean), o)))


def annotate_step(spark: SparkSession, config: dict, folders: Folders) -> None:
    c = config["annotation"]
    write_table(annotate.auto_label(read_table(spark, folders.clean)), folders.labeled)
    labeled = read_table(spark, folders.labeled)
    write_table(annotate.labelstudio_tasks(labeled), folders.tasks)
    queue = annotate.flag_for_review(labeled, c["confidence_threshold"], c["max_review_items"])
    if exists(spark, folders.results):  # what people have decided stays decided
        queue = review.preserve_state(queue, decisions(spark, folders.results), "_order")
    write_table(queue, folders.queue)
    reports.write(spark, folders.path("reports", "annotation_guidelines.md"), annotate.specification(labeled, "prompt classification"))


def gate_step(spark: SparkSession, config: dict, folders: Folders) -> tuple[bool, str]:
    def read(path):
        return read_table(spark, path) if exists(spark, path) else None

    try:
        queue = read(folders.queue)
    except Exception as e:  # a queue that can't be read doesn't stop the run
        return False, f"the review queue can't be read: {e}"
    try:
        results = read(folders.results)
    except Exception as e:
        return True, f"the review results can't be read: {e}"
    return review.gate(config["hitl"]["human_mode"], queue, results)


def merge_step(spark: SparkSession, config: dict, folders: Folders) -> None:
    decided = decisions(spark, folders.results) if exists(spark, folders.results) else None
    write_table(review.merge_decisions(read_table(spark, folders.labeled), decided, order="_order"), folders.final)


def learning_steps(spark: SparkSession, config: dict, folders: Folders) -> dict[str, DataFrame]:
    c, t = config["active_learning"], config["training"]
    final = read_table(spark, folders.final).withColumn("label", F.col("final_label"))
    rows = final.filter(~annotate.is_blank("label") & ~annotate.is_blank("text")).select(ROW_ID, "uid", "text", "label")
    seed = sampling.sample(rows, c["start"], c["seed"])
    pool = rows.join(seed.select(ROW_ID), ROW_ID, "left_anti")
    write_table(learning.export_candidates(learning.select_batch(pool, seed, c["strategy"], c["batch_size"])), folders.candidates)
    parts = sampling.split(rows, t["test_size"], t["seed"])
    test, train = parts.filter("_test").drop("_test"), parts.filter("not _test").drop("_test")
    start = sampling.sample(train, c["start"], c["seed"])
    left = train.join(start.select(ROW_ID), ROW_ID, "left_anti")
    histories = [h for s in c["strategies"] for h in learning.run_cycle(start, left, test, s, c["iterations"], c["step"])]
    history = spark.createDataFrame([(h["strategy"], h["iteration"], h["n_labeled"], float(h["accuracy"]), float(h["f1_macro"])) for h in histories], "strategy string, iteration int, n_labeled int, accuracy double, f1_macro double")
    _, report = learning.train_baseline(rows, label="label", fraction=t["test_size"], seed=t["seed"], model_path=folders.model)
    return {"learning curves": history, "sample savings": learning.sample_savings(history), "classification report": report}


def run(spark: SparkSession, config: dict) -> int:
    """0 when done, 2 when people have to decide first."""
    config, folders = with_defaults(config), Folders(config["base"])
    for step in (collect_step, rewrite_step, quality_step, annotate_step):
        step(spark, config, folders)
    stop, reason = gate_step(spark, config, folders)
    if stop:
        print(reason)
        return STOPPED
    merge_step(spark, config, folders)
    sections = learning_steps(spark, config, folders)
    paths = {k: getattr(folders, k) for k in ("raw", "clean", "labeled", "queue", "final", "candidates", "model")}
    reports.write(spark, folders.path("reports", "report.md"), reports.final(paths, sections))
    return DONE


