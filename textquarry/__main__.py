"""``python -m textquarry run CONFIG`` runs the pipeline, ``collect CONFIG`` its first step; ``rewrite|explore|quality|annotate|learn|train|review IN OUT`` are single steps."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textquarry", description=__doc__)
    p.add_argument("step", choices=("run", "collect", "rewrite", "explore", "quality", "annotate", "learn", "train", "review"))
    p.add_argument("paths", nargs="+")
    p.add_argument("--strategy", default="entropy")
    p.add_argument("--batch", type=int, default=100)
    p.add_argument("--reviewer")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("textquarry").getOrCreate()
    from .operators import annotate, eda, learning, quality, review, rewrite
    from .plans import config, pipeline, report
    from .sources.tables import read_table, write_table

    if a.step == "run":
        return pipeline.run(spark, config.load(a.paths[0]))
    if a.step == "collect":
        c = config.with_defaults(config.load(a.paths[0]))
        pipeline.collect_step(spark, c, config.Folders(c["base"]))
        return 0
    df = pipeline.numbered(read_table(spark, a.paths[0]))
    if a.step == "quality":
        done = quality.run(df, quality.QualityOptions())
        write_table(done["clean"], a.paths[1])
        print("\n".join(done["strategy"].reasoning))
    elif a.step == "rewrite":
        write_table(rewrite.run(df), a.paths[1])
    elif a.step == "explore":
        report.write(spark, a.paths[1], eda.markdown(eda.report(df)))
    elif a.step == "train":
        _, found = learning.train_baseline(df, label=annotate.preferred_label(df), model_path=a.paths[1])
        print(report.table(found))
    elif a.step == "annotate":
        write_table(annotate.auto_label(df), a.paths[1])
    elif a.step == "learn":
        column = annotate.preferred_label(df)
        rows = df.withColumn("label", F.col(column))
        write_table(learning.export_candidates(learning.select_batch(rows.filter(annotate.is_blank("label")), rows.filter(~annotate.is_blank("label")), a.strategy, a.batch)), a.paths[1])
    else:
        rows = [json.loads(x) for x in read_table(spark, a.paths[0]).toJSON().collect()]  # a person's queue
        done = review.review_rows(rows, input, reviewer=a.reviewer)
        with open(a.paths[1], "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in done)
    return 0


if __name__ == "__main__":
    sys.exit(main())
