import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as X
from textquarry.functions.numeric import exact_quantiles
from textquarry.operators import annotate, eda, generate, learning, quality, review, rewrite, sampling
from textquarry.plans import config
from textquarry.sources import collect, tables

O = quality.QualityOptions()  # noqa: E741


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_white_space_is_pythons(spark):
    samples = ["", " ", "a b", " a b　", "\x1ca\x85b\n", "x​Y", None, "  tab\tnew\nline "]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", X.strip(X.text_of("s")), X.word_count("s"), X.is_blank("s"), X.collapse("s")).orderBy("i").collect()
    for (_, stripped, words, blank, joined), s in zip(got, samples, strict=True):
        s = s or ""
        assert (stripped, words, blank, joined) == (s.strip(), len(s.split()), not s.strip(), " ".join(s.split()))


def test_exact_quantiles_equal_pandas(spark):
    r = random.Random(1)
    values = [r.gauss(0, 100) for _ in range(5000)] + [None, float("nan"), 3.0, 3.0, 3.0]
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int"), ["v", "i"], qs)
    want = pd.Series([v for v in values if v is not None and not math.isnan(v)]).quantile(qs)
    assert got["v"] == pytest.approx(list(want))
    assert got["i"] == pytest.approx(list(pd.Series(range(len(values))).quantile(qs)))
    assert exact_quantiles(spark.createDataFrame([], "v double"), ["v"], [0.5]) == {"v": [None]}


def test_fix_keeps_order_of_steps(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, "x y", None), (4, "x y", "a")], "_row_id bigint, text string, label string")
    out = quality.fix(df, quality.Strategy("fill", "drop", "keep"), O)
    assert rows(out, "_row_id", "text", "label") == [(1, "", "a"), (3, "x y", "")]
    assert rows(quality.fix(df, quality.Strategy("drop_critical_fill_optional", "drop", "keep"), O), "_row_id") == [(4,)]
    assert quality.duplicate_count(out, O).first()[0] == 0


def test_reports_of_an_empty_table(spark):
    df = spark.createDataFrame([], "_row_id bigint, text string, label string, x double")
    r = quality.detect(df, O)
    assert (r.n_rows, r.duplicates, r.total_missing, r.flagged, r.majority) == (0, 0, 0, 0, None)
    s = quality.choose_strategy(r, O)
    assert (s.missing, s.duplicates, s.outliers) == ("keep", "keep", "keep")


def test_chooser(spark):
    df = spark.createDataFrame([(i, "word " * 5, "a" if i < 19 else "b", None) for i in range(20)] + [(99, "word " * 4000, "a", 1.0)], "_row_id bigint, text string, label string, x double")
    s = quality.choose_strategy(quality.detect(df, O), O)
    assert (s.missing, s.duplicates, s.outliers) == ("fill", "drop", "drop_iqr")
    assert any("imbalance" in x for x in s.reasoning)
    done = quality.run(df, O)
    # two different texts are left, and of two values none lies outside their fences
    assert done["clean"].count() == 2 and done["comparison"].filter("metric = 'rows'").first()["after"] == 2


def largest_remainder(sizes, target):
    names, n = sorted(sizes), sum(sizes.values())
    if n <= target:
        return dict(sizes)
    if len(names) > target:
        return {k: int(i < target) for i, k in enumerate(names)}
    rest = target - len(names)
    raw = {k: rest * sizes[k] / n for k in names}
    extra = {k: min(int(raw[k]), sizes[k] - 1) for k in names}
    left, order = rest - sum(extra.values()), sorted(names, key=lambda k: (-(raw[k] - int(raw[k])), k))
    while left:
        for k in order:
            if left and extra[k] < sizes[k] - 1:
                extra[k] += 1
                left -= 1
    return {k: 1 + extra[k] for k in names}


@pytest.mark.parametrize("sizes,target", [({"a": 50, "b": 3, "c": 1}, 20), ({"a": 5, "b": 5}, 50), ({"a": 3, "b": 2, "c": 2}, 2), ({"a": 100, "b": 100, "c": 7, "d": 1, "e": 33}, 61)])
def test_stratified_sample(spark, sizes, target):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(k for k, n in sizes.items() for _ in range(n))], "_row_id bigint, source string")
    want = largest_remainder(sizes, target)
    assert dict(rows(sampling.allocate(df, target), "source", "n_taken")) == want
    got = sampling.stratified_sample(df, target)
    assert got.count() == sum(want.values()) and dict(rows(got.groupBy("source").count(), "source", "count")) == {k: v for k, v in want.items() if v}


def test_row_cap():
    assert sampling.row_cap(None) is sampling.row_cap(0) is None and sampling.row_cap(3) == 3
    with pytest.raises(ValueError):
        sampling.row_cap(True)


def test_wiki_items(spark):
    page = "== Head ==\n{| table\n|-\n! x\n* one [[a|'''two''']]\n# [[three]]\n| [[Category:c]] || [[en:d]] || [[Target|shown]]\n{{t}}\n[[:File:x]]\nplain\n|}"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "i int, wikitext string")
    assert [r["item"] for r in collect.wiki_items(df).orderBy("i", "item_no").collect()] == ["one two", "three", "shown"]
    assert [r["item"] for r in collect.wiki_items(df, plain_lines=True).orderBy("i", "item_no").collect()] == ["one two", "three", "shown", "[[:File:x]]".strip("[]"), "plain"][:3] + ["plain"]


def test_selectors():
    page = '<div class="x y" id="m"><p>One <b>two</b></p><a href="/u?a=1&amp;b=2">l</a><script>no</script></div><p>three'
    assert collect.select_nodes(page, "div.x p") == ["One two"] and collect.select_nodes(page, "p") == ["One two", "three"]
    assert collect.select_nodes(page, "#m a", "href") == ["/u?a=1&b=2"] and collect.select_nodes(None, "p") == []
    with pytest.raises(ValueError):
        collect.select_nodes(page, "a[href]")


def test_export_records_pages(spark):
    df = spark.createDataFrame([("a ", 1, "x"), (" ", 0, "x"), ("b", None, "y")], "text string, label int, lang string")
    out = collect.from_export(df, "s", "text", filters=[{"column": "lang", "op": "in", "value": ["x", None]}]).collect()
    assert [(r["text"], r["label"], r["_row_id"]) for r in out] == [("a", "1", 0)]
    assert collect.from_export(df, "s", "text", constant_label="c").select("label").distinct().collect()[0][0] in ("c", "1")
    got = collect.from_records(spark, {"q": {"items": [{"text": "t", "l": 5}, "bare", {"text": None}]}}, "api", "q.items", label_field="l")
    assert rows(got, "text", "label") == [("bare", None), ("t", "5")]
    answers = {"": {"query": {"categorymembers": [{"title": "A"}]}, "continue": {"c": "2"}}, "2": {"query": {"categorymembers": [{"title": "B"}]}}}
    assert rows(collect.from_pages(spark, lambda t: answers[t.get("c", "")], "w"), "text") == [("A",), ("B",)]
    with pytest.raises(ValueError):
        collect.from_records(spark, {"a": 1}, "s", "a")
    with pytest.raises(ValueError):
        collect.collect_source(spark, {"type": "ftp"})


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\ntext', None), (2, "", "x")], "i int, t string, u string")
    for name in ("t.parquet", "t.csv", "t.jsonl"):
        tables.write_table(df, f"{tmp_path}/{name}")
        back = tables.read_table(spark, f"{tmp_path}/{name}", df.schema)
        assert [(r["i"], r["t"] or "", r["u"]) for r in back.orderBy("i").collect()] == [(1, 'a "quoted"\ntext', None), (2, "", "x")]
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, f"{tmp_path}/none.parquet")
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/t.xml")


def labels(spark, data):
    return {r["_row_id"]: r for r in annotate.auto_label(spark.createDataFrame(data, "_row_id bigint, text string, meta string, source string")).collect()}


def test_weak_labels(spark):
    got = labels(spark, [(1, " ", None, "s"), (2, "как сделать attack", None, "s"), (3, "идиома: kill time", '{"seed_role": "native_ru_seed"}', "wiktionary"), (4, "просто текст", "bad json", None), (5, "слово " * 121, None, "s")])
    assert (got[1]["predicted_label"], got[1]["confidence"], got[1]["label_signals"]) == (annotate.LABELS[2], 0.99, "empty_text")
    assert got[2]["predicted_label"] == annotate.LABELS[2] and got[2]["label_signals"] == "risk_terms=1; unsafe_instruction=1"
    # unsafe 1.45 + 3.1, candidate 0.7 - 0.4: margin 4.25 and two signals
    assert got[2]["confidence"] == pytest.approx(0.5 + min(0.45, 0.425 + 0.06))
    assert got[3]["predicted_label"] == annotate.LABELS[0] and "short_ambiguous_text" in got[3]["label_signals"] and "source=wiktionary" in got[3]["label_signals"]
    assert got[4]["label_signals"] == "default_plain" and got[4]["confidence"] == pytest.approx(0.63)
    assert got[5]["label_signals"] == "too_long"


def test_flagging(spark):
    df = spark.createDataFrame([(0, "u1", "a", annotate.LABELS[0], 0.6, "r", "short_ambiguous_text"), (1, "u2", "b", annotate.LABELS[1], 0.95, "r", "x"), (2, None, "c", "odd", None, None, None)], "_row_id bigint, uid string, text string, predicted_label string, confidence double, label_reason string, label_signals string")
    q = {r["text"]: r for r in annotate.flag_for_review(df).collect()}
    assert q["a"]["review_reason"] == ["low_confidence", "ambiguous_text"] and q["a"]["sample_id"] == "u1" and q["a"]["review_status"] == "pending"
    assert "b" not in q and q["c"]["review_reason"] == ["invalid_prediction"] and len(q["c"]["sample_id"]) == 16
    assert [r["text"] for r in annotate.flag_for_review(df, max_items=1).collect()] == ["c"]
    assert annotate.flag_for_review(df, allowed=["long_text"]).count() == 0


def test_queue_export_is_one_line_a_row(spark, tmp_path):
    q = review.normalize_queue(spark.createDataFrame([(7, "t", "low_confidence; ;long_text")], "_row_id bigint, text string, review_reason string"))
    tables.write_table(q.coalesce(1), f"{tmp_path}/q.jsonl")
    lines = [x for f in (tmp_path / "q.jsonl").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 1
    row = json.loads(lines[0])
    assert row["review_reason"] == ["low_confidence", "long_text"] and row["review_status"] == "pending" and list(row)[:14] == list(review.QUEUE)


def test_merge_decisions(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"t{i}", "p") for i in range(5)], "_row_id bigint, uid string, text string, predicted_label string")
    dec = spark.createDataFrame([(1, "u0", "pending", None), (2, "u0", "corrected", "h"), (3, "u1", "accepted_auto", None), (4, "u2", "skipped", None), (5, "u3", "corrected", " ")], "_row_id bigint, sample_id string, review_status string, human_label string")
    got = {r["uid"]: (r["final_label"], r["reviewed"], r["review_status"], r["human_label"]) for r in review.merge_decisions(df, dec).collect()}
    assert got == {"u0": ("h", True, "corrected", "h"), "u1": ("p", True, "accepted_auto", "p"), "u2": ("p", False, "skipped", None), "u3": ("p", False, "corrected", " "), "u4": ("p", False, "pending", None)}
    assert review.merge_decisions(df, None).select("final_label").distinct().collect()[0][0] == "p"


def test_state_survives_a_new_queue(spark):
    new = review.normalize_queue(spark.createDataFrame([(0, "a", "t"), (1, "b", "t")], "_row_id bigint, sample_id string, text string"))
    old = spark.createDataFrame([(0, "a", "pending", None), (1, "a", "corrected", "mine")], "_row_id bigint, sample_id string, review_status string, review_note string")
    got = {r["sample_id"]: (r["review_status"], r["review_note"]) for r in review.preserve_state(new, old).collect()}
    assert got == {"a": ("corrected", "mine"), "b": ("pending", None)}


def test_gate(spark):
    q = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    r = spark.createDataFrame([("a", "skipped"), ("b", "pending")], "sample_id string, review_status string")
    assert review.gate("off", q, None) == (False, "") and review.gate("stop_if_missing", None, None) == (False, "") and review.gate("stop_if_missing", q.limit(0), None) == (False, "")
    assert review.gate("stop_if_missing", q, None)[0] and review.gate("stop_if_missing", q, r) == (True, "1 rows of the queue are still undecided")
    assert not review.gate("stop_if_missing", q, r.withColumn("review_status", F.lit("corrected")))[0]
    assert review.gate("stop_if_missing", q, r.select("review_status"))[0]


def test_console():
    q = [{"sample_id": "a", "pred_label": "p"}, {"sample_id": "b", "pred_label": "p", "review_status": "corrected"}, {"sample_id": "c", "pred_label": "p"}, {"sample_id": "d", "pred_label": "p"}]
    answers, saved = iter(["n", "hm", "9", "2", "s", "q"]), []
    out = review.review_rows(q, lambda _: next(answers), lambda _: None, saved.append, reviewer="me", now="T")
    assert (out[0]["human_label"], out[0]["review_status"], out[0]["review_note"], out[0]["reviewer"]) == (annotate.LABELS[1], "corrected", "hm", "me")
    assert out[2]["review_status"] == "skipped" and "review_status" not in out[3] and len(saved) == 4
    assert review.apply_action({"pred_label": "p"}, "a", now="T")["review_status"] == "accepted_auto" and review.apply_action({}, "zz") is None


def test_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("a", None), ("", "a")], "predicted_label string, final_label string")
    r = annotate.agreement(annotate.paired(df)[0]).first()
    assert (r["agreement_n"], r["agreement"]) == (4, 0.75) and r["kappa"] == pytest.approx(0.5)
    assert annotate.agreement(annotate.paired(df.filter("predicted_label = 'b'"))[0]).first()["kappa"] is None
    assert annotate.check_quality(df)["confusion"][("b", "a")] == 1


def test_artifacts_and_detectors(spark):
    def one(c, t):
        return spark.createDataFrame([(t,)], "t string").select(c).first()[0]

    for t, want in (('"a b"', "a b"), ("«x»", "x"), ("Вот вариант: текст", "текст"), ("вариант 1\nx", "x"), ("вот вариант - вариант 2: y", "y"), ("вариант 10: z", "вариант 10: z"), (None, "")):
        assert one(X.without_artifacts("t"), t) == want
    assert one(X.looks_like_query("t"), "Что это") and one(X.looks_like_query("t"), "ну как же") and not one(X.looks_like_query("t"), "объясни, да")
    assert one(X.looks_like_dictionary("t"), "Термин из физики") and one(X.looks_like_dictionary("t"), "Кот — это зверь") and not one(X.looks_like_dictionary("t"), "Кот — это зверь?")
    assert one(X.looks_like_several("t"), "a\n- b") and one(X.looks_like_several("t"), "x --- y") and one(X.looks_like_several("t"), "вариант 1\nвариант 2") and not one(X.looks_like_several("t"), "вариант 1")
    assert one(X.default_source_name("t", "f"), "https://h.org:8080/a/b/?q") == "h.org:8080::b" and one(X.default_source_name("t", "f"), "x") == "f"


def test_rewrite_variants(spark):
    p = rewrite.Policy("p", ("r",), "generate_borderline_ru", n_variants=3)
    o = rewrite.RewriteOptions(policies=(p,), keep_original=False, alternative_share=0.0)
    df = spark.createDataFrame([(1, "u", "кот", '{"seed_role": "r", "z": 1}', "s"), (2, "v", " ", '{"seed_role": "r"}', "s"), (3, "w", "x", '{"seed_role": 7}', "s")], "_row_id bigint, uid string, text string, meta string, source string")
    out = rewrite.run(df, o).collect()
    assert len(out) == 3 and out[0]["source"] == "s:rewrite" and len({r["uid"] for r in out}) == 3
    meta = json.loads(out[0]["meta"])
    assert list(meta) == sorted(meta) and meta["z"] == "1" and meta["seed_role"] == rewrite.LABEL and meta["generation_mode"] == "multi_variant"

    def given(d, _):
        return d.withColumn("raw", F.array(F.lit("как быть --- Как  быть --- вот вариант: что делать --- да")))

    checked = {r["candidate"]: list(r["reject_reasons"]) for r in rewrite.validate(rewrite.expand(given(rewrite.match_policies(df, o), o), rewrite.RewriteOptions(policies=(rewrite.replace(p, n_variants=4),))), rewrite.RewriteOptions(policies=(rewrite.replace(p, n_variants=4),))).collect()}
    assert checked == {0: [], 1: ["duplicate"], 2: [], 3: ["too_few_words"]}
    assert rewrite.legacy(df, o, n_variants=2).count() == 4 and rewrite.token_cap(900, 1) == 512 and rewrite.token_cap(None, 2) == 800
    assert "request" in rewrite.prompt(p, "t", 2)[0]


def test_diverse_equals_greedy_loop():
    r = np.random.default_rng(3)
    for _ in range(30):
        x = r.normal(size=(40, 3))
        x /= np.linalg.norm(x, axis=1)[:, None]
        taken, left = [], list(range(40))
        while len(taken) < 8:
            k = next((i for i in left if not taken or max(x[j] @ x[i] for j in taken) < 0.85), left[0])
            taken.append(k)
            left.remove(k)
        assert sorted(learning.diverse(x, 8)) == sorted(taken)


@pytest.mark.parametrize("strategy", ["entropy", "margin"])
def test_batches_hold_no_near_copies(spark, strategy):
    seen = [(i, f"good fine nice day number{i % 7}", "p") for i in range(10)] + [(100 + i, f"bad awful poor night number{i % 7}", "n") for i in range(10)]
    model = learning.fit(spark.createDataFrame(seen, "_row_id bigint, text string, label string"))
    pool = [(200 + i, "good bad") for i in range(8)] + [(300 + i, f"{a} {b} {c}") for i, (a, b, c) in enumerate([("fine", "fine", "awful"), ("nice", "nice", "poor"), ("day", "day", "night"), ("good", "good", "awful")])]
    got = {r[0] for r in learning.query(spark.createDataFrame(pool, "_row_id bigint, text string"), strategy, 3, model).collect()}
    assert len(got) == 3 and len([i for i in got if i < 300]) == 1


def test_al_cycle_runs_all_strategies_for_five_iterations(spark, monkeypatch):
    from textquarry import catalog

    ran = []
    monkeypatch.setattr(learning, "run_cycle", lambda start, left, test, strategy, iterations=5, batch=20, row_id="_row_id": ran.append((strategy, iterations)) or [{"strategy": strategy, "iteration": 0, "n_labeled": 1, "accuracy": 1, "f1_macro": 1}])
    catalog.QUERIES["al_cycle"](spark, "/root/testdata/sf0.001")
    assert ran == [("random", 5), ("entropy", 5), ("margin", 5)]


def test_learning(spark):
    data = [(i, f"good fine nice day number{i % 7}", "p") for i in range(30)] + [(100 + i, f"bad awful poor night number{i % 7}", "n") for i in range(30)]
    df = spark.createDataFrame(data, "_row_id bigint, text string, label string")
    model, report = learning.train_baseline(df, label="label")
    assert {r["label"]: r for r in report.collect()}["accuracy"]["f1"] == 1.0 and model.labels == ["n", "p"]
    start = df.filter("_row_id in (0, 1, 100, 101)")
    history = learning.run_cycle(start, df.join(start.select("_row_id"), "_row_id", "left_anti"), df, "entropy", iterations=2, batch=4)
    assert [h["n_labeled"] for h in history] == [4, 8] and history[-1]["f1_macro"] > 0.9
    batch = learning.select_batch(df.filter("_row_id > 110").drop("label"), start, "margin", 5)
    assert batch.count() == 5 and {"uncertainty", "margin", "predicted_label"} <= set(batch.columns)
    assert json.loads(learning.export_candidates(batch).first()["task"])["data"]["predicted_label"] in ("n", "p")
    with pytest.raises(ValueError):
        learning.fit(df.filter("label = 'p'"))


def test_fit_of_few_rows_is_the_same_model_in_few_jobs(spark, monkeypatch):
    data = [(f"{a} word{i % 5} {b} day{i % 3}" if i % 11 else " ", c) for i, (a, b, c) in enumerate([("good", "fine", "p"), ("bad", "poor", "n"), ("good", "poor", "q")] * 20)]
    df = spark.createDataFrame(data, "text string, label string").coalesce(2)
    spark.sparkContext.setJobGroup("fit-here", "")
    here = learning.fit(df)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit-here")
    spark.sparkContext.setJobGroup("fit-spark", "")
    assert len(jobs) <= 12
    monkeypatch.setattr(learning, "HERE_CHARS", 0)
    there = learning.fit(df)
    assert here.labels == there.labels == ["n", "p", "q"]
    terms = lambda m: m.pipeline.stages[3].vocabulary
    weights = lambda m: {t: x for t, x in zip(terms(m), m.pipeline.stages[-1].coefficientMatrix.toArray().T, strict=True)}
    a, b = weights(here), weights(there)
    assert set(a) == set(b) and max(abs(a[t] - b[t]).max() for t in a) < 2e-3
    pair = zip(here.transform(df).collect(), there.transform(df).collect(), strict=True)
    assert all(x["predicted_label"] == y["predicted_label"] and max(abs(p - q) for p, q in zip(x["proba"], y["proba"], strict=True)) < 1e-3 for x, y in pair)


@pytest.mark.parametrize("bigrams", [True, False])
def test_tfidf_in_chunks_moves_no_row_an_occurrence(spark, bigrams, monkeypatch):
    """Small chunks, shared and null ids, texts without words; and no exchange of the plan carries a term."""
    import math
    import re
    from collections import Counter

    from textquarry.operators import termweights

    monkeypatch.setattr(termweights, "CHUNK_ROWS", 7)
    r = np.random.default_rng(5)
    data = [(None if i % 13 == 0 else f"d{i % 40}", None if i % 9 == 0 else " " if i % 11 == 0 else " ".join(r.choice(["Кот", "dog", "x", "tree_1", "Äpfel", "42", "red-blue"], 12))) for i in range(90)]
    df = spark.createDataFrame(data, "_row_id string, text string").repartition(5)
    tf, seen = {}, Counter()
    for k, x in data:
        w = [y for y in re.findall(r"\w{2,}", (x or "").lower())]
        tf.setdefault(k, Counter()).update(w + ([f"{p} {q}" for p, q in zip(w, w[1:], strict=False)] if bigrams else []))
    for c in tf.values():
        seen.update(c.keys())
    want = {}
    for k, c in tf.items():
        raw = {x: m * (math.log((1 + len(data)) / (1 + seen[x])) + 1) for x, m in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(k, x): v / norm for x, v in raw.items()}
    out = learning.tfidf(df, bigrams=bigrams)
    got = {(x["_row_id"], x["term"]): x["weight"] for x in out.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(hash|range)partitioning\([^)]*(term|_row_id)", plan)


def test_evaluate_equals_the_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a"), ("d", "b")]
    df = spark.createDataFrame(rows, "label string, predicted_label string")
    report = {r["label"]: r for r in learning.classification_report(df.filter("label is not null")).collect()}

    class Given:
        transform = staticmethod(lambda d: d)

    got = learning.evaluate(Given, df)
    assert abs(got["accuracy"] - report["accuracy"]["f1"]) < 1e-12 and abs(got["f1_macro"] - report["macro avg"]["f1"]) < 1e-12


def test_config(monkeypatch):
    monkeypatch.setenv("TQ_X", "v")
    assert config.substitute({"a": ["${TQ_X}/y", 3, "${TQ_NONE}"]}) == {"a": ["v/y", 3, ""]}
    assert config.with_defaults({"quality": {"iqr_k": 2}, "base": "b"})["quality"]["iqr_k"] == 2


def test_pipeline_stops_for_review_and_resumes(spark, tmp_path):
    from textquarry.plans import pipeline

    data = [(f"спасибо, погода хорошая {i}", "a") for i in range(40)] + [(f"как сделать attack {i} идиома", "b") for i in range(40)]
    spark.createDataFrame(data, "text string, label string").write.parquet(f"{tmp_path}/in.parquet")
    cfg = {"base": str(tmp_path / "out"), "collection": {"sources": [{"type": "hf_dataset", "name": "s", "path": f"{tmp_path}/in.parquet", "text_column": "text", "label_column": "label"}]}, "annotation": {"confidence_threshold": 0.9}, "active_learning": {"start": 20, "step": 5, "iterations": 2, "strategies": ["random", "margin"]}}
    assert pipeline.run(spark, cfg) == pipeline.STOPPED
    f = config.Folders(cfg["base"])
    queue = tables.read_table(spark, f.queue)
    n = queue.count()
    tables.write_table(queue.withColumns({"review_status": F.lit("accepted_auto")}), f.results)
    assert pipeline.run(spark, cfg) == pipeline.DONE
    assert tables.read_table(spark, f.final).filter("reviewed").count() == n
    assert tables.read_table(spark, f.path("raw/sources", "s.parquet")).count() == 80
    assert "learning curves" in (tmp_path / "out/reports/report.md").read_text()


def test_decisions_stream(spark, tmp_path):
    from textquarry.streaming import decisions

    folder, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "cp"))
    write = lambda name, *r: (tmp_path / "in").mkdir(exist_ok=True) or (tmp_path / "in" / name).write_text("".join(json.dumps(x) + "\n" for x in r))
    write("1.json", {"sample_id": "a", "review_status": "pending", "review_timestamp": "1"}, {"sample_id": "b", "review_status": "skipped", "review_timestamp": "1"})
    decisions.run(spark, folder, state, checkpoint).awaitTermination()
    write("2.json", {"sample_id": "a", "review_status": "corrected", "review_timestamp": "2"})
    decisions.run(spark, folder, state, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(decisions.state_path(state, 1)), "sample_id", "review_status") == [("a", "corrected"), ("b", "skipped")]


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(500)], "k int, t string").repartition(7).sortWithinPartitions("k")
    df.write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    got = collect.number_rows(df)
    assert got.columns == ["k", "t", "_row_id"] and [r["k"] for r in got.orderBy("_row_id").collect()] == [r["k"] for r in df.collect()]
    assert sorted(r["_row_id"] for r in got.collect()) == list(range(500)) and collect.number_rows(df.limit(0)).count() == 0
    assert [r["_row_id"] for r in collect.number_rows(df, order=["k"]).orderBy("k").collect()] == list(range(500))


def test_quality_step_keeps_one_of_equal_rows(spark, tmp_path):
    """Tables without uid or row numbers, through the command line."""
    from textquarry.__main__ import main

    with open(f"{tmp_path}/in.csv", "w") as f:
        f.write("text,label\n" + "same words here,a\n" * 3 + "other words here,b\nwords of a third,b\n")
    assert main(["quality", f"{tmp_path}/in.csv", f"{tmp_path}/out.parquet"]) == 0
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out.parquet").collect()) == ["other words here", "same words here", "words of a third"]


@pytest.mark.parametrize("slot", [2, 1000])
def test_stratified_split_equals_brute_force(spark, monkeypatch, slot):
    import hashlib
    import math

    monkeypatch.setattr(sampling, "SLOT", slot)
    data = [(i, [None, "a", "b"][min(2, i % 5)]) for i in range(300)] + [(900, "one")]
    for fraction in (0.0, 0.2, 1.0):
        want = set()
        for label in {x for _, x in data}:
            ids = sorted((hashlib.sha256(f"42|{i}".encode()).hexdigest(), i) for i, x in data if x == label)
            want |= {i for _, i in ids[: math.ceil(len(ids) * fraction)]}
        got = sampling.split(spark.createDataFrame(data, "_row_id bigint, label string"), fraction, 42, "label")
        assert got.columns == ["_row_id", "label", "_test"] and {r["_row_id"] for r in got.collect() if r["_test"]} == want and got.count() == len(data)


def test_nearest_in_blocks_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8)).round(2)
    v[7], v[8] = v[3], v[3]
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 8)], "vec_id bigint, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {}
    for q in range(0, 120, 20):
        s = np.round(u @ u[q], 9)
        want[q] = [i for i in sorted(range(120), key=lambda i: (-s[i], i)) if i != q][:4]
    for block, rows in ((4096, 65_536), (2, 17)):
        got = {}
        for r in learning.nearest(df, df.filter("vec_id % 20 = 0 and vec_id < 200"), 4, block=block, data_block=rows).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append(r["vec_id"])
        assert got == want


def test_a_model_works_after_an_observation(spark):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rows = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} word{i}", "ab"[i % 2]) for i in range(12)], "_row_id bigint, text string, label string")
    assert learning.fit(rows).transform(rows).count() == 12


def test_unknown_strategy_warns(spark):
    with pytest.warns(UserWarning):
        assert quality.apply_missing(spark.range(3), "nonsense", quality.QualityOptions()).count() == 3


def test_a_busy_service_is_asked_again():
    asked, slept = [], []

    def call(system, user, tokens):
        asked.append(tokens)
        if len(asked) < 4:
            raise generate.Busy(5.0 if len(asked) == 2 else None)
        return "ok"

    assert generate.Service(call, wait=1.0).ask("s", "u", 7, slept.append) == "ok" and asked == [7] * 4 and slept == [1.0, 5.0, 4.0]
    asked.clear()
    with pytest.raises(generate.Busy):
        generate.Service(call, retries=2).ask("s", "u", 7, lambda _: None)


def test_generators(spark):
    """The service's text, the rule's where it fails (hybrid), the error (llm), rules without a service."""
    df = spark.createDataFrame([(1, "u", "кот", '{"seed_role": "r"}', "s"), (2, "v", "пёс", '{"seed_role": "r"}', "s"), (3, "w", None, '{"seed_role": "r"}', "s")], "_row_id bigint, uid string, text string, meta string, source string")
    o = rewrite.RewriteOptions(policies=(rewrite.Policy("p", ("r",), "generate_borderline_ru"),), keep_original=False, alternative_share=0.0, mode="hybrid")

    def call(system, user, tokens):
        if "пёс" in user:
            raise OSError("no route")
        return f"как правильно ответить на вопрос {tokens}"

    ruled = {r["uid"]: r["text"] for r in rewrite.run(df, o).collect()}
    got = rewrite.run(df, o, generate.generator(generate.Service(call), "hybrid")).collect()
    assert len(ruled) == 2 and len(got) == 2
    texts = {json.loads(r["meta"])["parent_uid"]: r["text"] for r in got}
    assert texts == {"u": "как правильно ответить на вопрос 512", "v": next(t for t in ruled.values() if "пёс" in t)}
    assert {json.loads(r["meta"])["rewrite_mode"] for r in got} == {"hybrid"}
    with pytest.raises(Exception, match="no route"):
        rewrite.run(df, o, generate.generator(generate.Service(call))).collect()
    assert generate.generator() is rewrite.rule_generate
    with pytest.raises(ValueError):
        generate.generator(mode="llm")


def test_lemmas_join_words(spark):
    df = spark.createDataFrame([("cats cat dogs",), ("dog cats an",), (None,)], "text string")
    assert [tuple(r) for r in eda.top_words(df, k=2, stop=set(), lemma=lambda w: w.rstrip("s")).collect()] == [("cat", 3), ("dog", 2)]
    assert [tuple(r) for r in eda.top_words(df, stop={"cat"}, lemma=lambda w: w.rstrip("s")).collect()] == [("dog", 2)]


def test_pivot_holds_what_compare_says(spark):
    df = spark.createDataFrame([(i, ["word " * (1 + i % 4), None, "x"][i % 3], "ab"[i % 2]) for i in range(30)], "_row_id bigint, text string, label string")
    ways = {"keep": quality.Strategy("keep", "keep", "keep"), "hard": quality.Strategy("drop", "drop", "drop_iqr")}
    got = {r["metric"]: r.asDict() for r in quality.pivot(df, ways, O).collect()}
    for name, s in ways.items():
        after = {r["metric"]: r["after"] for r in quality.compare(df, quality.fix(df, s, O), O).collect()}
        assert {m: got[m][name] for m in after} == after
    assert got["rows"]["keep"] == 30 and got["rows"]["hard"] < 30


def test_command_line_steps(spark, tmp_path, capsys):
    from textquarry.__main__ import main

    data = [(i, f"u{i}", f"{'спасибо, погода хорошая' if i % 2 else 'как сделать это'} {i}", "ab"[i % 2], "s", '{"seed_role": "safe_seed_en"}') for i in range(40)]
    spark.createDataFrame(data, "_row_id bigint, uid string, text string, label string, source string, meta string").write.parquet(f"{tmp_path}/in.parquet")
    assert main(["rewrite", f"{tmp_path}/in.parquet", f"{tmp_path}/re.parquet"]) == 0 and spark.read.parquet(f"{tmp_path}/re.parquet").count() > 40
    assert main(["explore", f"{tmp_path}/in.parquet", f"{tmp_path}/eda.md"]) == 0 and "## top_words" in (tmp_path / "eda.md").read_text()
    assert main(["train", f"{tmp_path}/in.parquet", f"{tmp_path}/model"]) == 0 and "macro avg" in capsys.readouterr().out
    (tmp_path / "c.yaml").write_text(f"base: {tmp_path}/out\ncollection:\n  sources:\n  - {{type: hf_dataset, name: a/b, path: {tmp_path}/in.parquet, text_column: text}}\n")
    assert main(["collect", f"{tmp_path}/c.yaml"]) == 0 and spark.read.parquet(f"{tmp_path}/out/raw/sources/a_b.parquet").count() == 40
    assert spark.read.parquet(f"{tmp_path}/out/raw/merged.parquet").count() == 40


def _mixed(spark, n=240):
    r = np.random.default_rng(5)
    own = {"p": ["good", "fine", "nice"], "n": ["bad", "poor", "awful"], "q": ["odd", "even", "prime"]}
    every = [w for x in own.values() for w in x]
    rows = [(i, " ".join([*r.choice(own["pnq"[i % 3]], 3), *r.choice(every, 4), f"Слово{i % 9}", "x"]) if i % 17 else " . ", "pnq"[i % 3]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, rows[3][1], None), (n + 1, rows[3][1], "p")], "_row_id bigint, text string, label string").coalesce(3)


@pytest.mark.parametrize("features", [20_000, 40])
def test_word_model_is_the_model_of_fit(spark, monkeypatch, features):
    df = _mixed(spark)
    monkeypatch.setattr(learning, "MAX_FEATURES", features)
    rows = learning.prepared(df).toArrow()
    fitted = learning.fit(df, max_features=features)
    stages = fitted.pipeline.stages
    same = learning.wordmodel.from_terms(stages[3].vocabulary, stages[4].getScalingVec().toArray(), stages[-1].coefficientMatrix.toArray(), stages[-1].interceptVector.toArray(), fitted.labels)
    want = {r[0]: r[1] for r in fitted.transform(df).select("_row_id", "proba").collect()}
    texts = rows[learning.WORDS].combine_chunks()
    assert len(same.keys) == len(stages[3].vocabulary) <= features
    assert all(max(abs(a - b) for a, b in zip(want[i], p, strict=True)) < 1e-9 for i, p in zip(rows["_row_id"].to_pylist(), same.probabilities(texts), strict=True))
    if features == 20_000:  # no ties at the end of the vocabulary
        assert abs(learning._learned(rows).probabilities(texts) - same.probabilities(texts)).max() < 1e-4


@pytest.mark.parametrize("strategy", ["entropy", "margin"])
def test_a_pass_gives_the_figures_and_the_first_rows_of_rank(spark, monkeypatch, strategy):
    df = _mixed(spark)
    monkeypatch.setattr(learning.wordmodel, "SLICE_BYTES", 500)
    fitted, rows = learning.fit(df), learning.prepared(df)
    stages = fitted.pipeline.stages
    model = learning.wordmodel.from_terms(stages[3].vocabulary, stages[4].getScalingVec().toArray(), stages[-1].coefficientMatrix.toArray(), stages[-1].interceptVector.toArray(), fitted.labels)
    pairs, ids = learning._scored(model, rows.filter("_row_id % 3 < 2"), rows.filter("_row_id % 2 = 0"), strategy, 30, "_row_id")
    assert learning._figures(pairs) == learning.evaluate(fitted, df.filter("_row_id % 3 < 2"))
    scored = learning.with_uncertainty(fitted.transform(df.filter("_row_id % 2 = 0"))).select("_row_id", F.round("uncertainty", 9).alias("uncertainty"), F.round("margin", 9).alias("margin"))
    assert ids == [r[0] for r in learning.rank(scored, strategy).limit(30).collect()]


@pytest.mark.parametrize("strategy", ["random", "entropy", "margin"])
def test_cycle_in_few_jobs_and_the_same_by_spark(spark, monkeypatch, strategy):
    df = _mixed(spark)
    start, left, test = (learning.staged(learning.prepared(df.filter(x))) for x in ("_row_id < 12", "_row_id >= 12 and _row_id % 4 > 0", "_row_id >= 12 and _row_id % 4 = 0"))
    spark.sparkContext.setJobGroup(f"cycle-{strategy}", "")
    here = learning.run_cycle(start, left, test, strategy, iterations=3, batch=6)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"cycle-{strategy}")
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) <= 12 and [h["n_labeled"] for h in here] == [12, 18, 24] and here[0]["accuracy"] > 0.5
    if strategy == "random":  # the batches do not depend on the model
        monkeypatch.setattr(learning, "HERE_CHARS", 0)
        assert learning.run_cycle(start, left, test, strategy, iterations=3, batch=6) == here


def test_cycle_with_one_class_gives_a_note_and_no_error(spark):
    df = _mixed(spark)
    got = learning.run_cycle(df.filter("_row_id in (0, 3)"), df.filter("_row_id > 3"), df, "entropy", iterations=3, batch=6)
    assert len(got) == 1 and got[0]["n_labeled"] == 2 and got[0]["f1_macro"] != got[0]["f1_macro"] and "note" in got[0]


def test_split_of_few_strata_moves_no_texts(spark):
    df = spark.createDataFrame([(i, f"text {i}", "pnq"[i % 3]) for i in range(300)], "_row_id bigint, text string, label string")
    kept = sampling.split(df, 0.2, 42, "label", few=True)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in sampling.split(df, 0.2, 42, "label").collect()}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if " Exchange hashpartitioning" in x and "text" in x] and "SortMergeJoin" not in plan
