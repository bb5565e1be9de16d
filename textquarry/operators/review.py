"""Human review: queue in a stable schema, preserved state, gate, merge of decisions, and the state machine behind a console."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip, text_of
from .annotate import DECIDED, LABELS, reason_list, sample_id

QUEUE = ("sample_id", "uid", "text", "pred_label", "pred_confidence", "review_reason", "human_label", "final_label", "review_status", "reviewer", "review_note", "review_timestamp", "label_reason", "label_signals")
STATE = ("human_label", "final_label", "review_status", "reviewer", "review_note", "review_timestamp")


def normalize_queue(df: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """All queue columns, filled from their counterparts or with defaults, then any others; the row id goes."""
    have = set(df.columns)
    first = lambda *names: next((F.col(n) for n in names if n in have), F.lit(None))
    sid = F.col("sample_id").cast("string") if "sample_id" in have else sample_id(df, row_id)
    reasons = F.array().cast("array<string>")
    if "review_reason" in have:
        is_list = df.schema["review_reason"].dataType.typeName() == "array"
        reasons = F.coalesce(F.filter(F.transform("review_reason", strip), lambda x: x != ""), reasons) if is_list else reason_list(F.col("review_reason"))
    made: dict[str, Column] = {
        "sample_id": sid, "uid": F.coalesce(first("uid").cast("string"), sid), "text": text_of(first("text")), "pred_label": first("pred_label", "predicted_label", "label").cast("string"),
        "pred_confidence": first("pred_confidence", "confidence").cast("double"), "review_reason": reasons, **{c: first(c).cast("string") for c in STATE},
        "label_reason": text_of(first("label_reason")), "label_signals": text_of(first("label_signals")),
    }
    made["review_status"] = F.coalesce(first("review_status").cast("string"), F.lit("pending"))
    return df.select(*[made[c].alias(c) for c in QUEUE], *[c for c in df.columns if c not in QUEUE and c != row_id])


def last_by_id(df: DataFrame, columns: Iterable[str], order: str, key: str = "sample_id") -> DataFrame:
    """The last row of each id, by partial aggregation."""
    packed = F.max_by(F.struct(*columns), F.col(order)).alias("_s")
    return df.groupBy(key).agg(packed).select(key, "_s.*")


def preserve_state(queue: DataFrame, existing: DataFrame, order: str = "_row_id") -> DataFrame:
    """Review columns of the existing queue win where they are set; of several rows with an id the last counts."""
    have = [c for c in STATE if c in existing.columns]
    old = last_by_id(existing.withColumn("sample_id", F.col("sample_id").cast("string")), have, order).select("sample_id", *[F.col(c).alias(f"_old_{c}") for c in have])
    joined = queue.join(old, "sample_id", "left")
    keep = {c: F.when(is_blank(f"_old_{c}"), F.col(c)).otherwise(F.col(f"_old_{c}").cast("string")) for c in have}
    return joined.withColumns(keep).select(*queue.columns)


def pending(queue: DataFrame, limit: int | None = None) -> DataFrame:
    out = queue.filter(~F.coalesce("review_status", F.lit("pending")).isin(*DECIDED))
    return out.orderBy("sample_id").limit(limit) if limit is not None else out


def _id_column(df: DataFrame) -> str | None:
    return next((c for c in ("sample_id", "uid") if c in df.columns), None)


def undecided(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Queue rows without a decided result."""
    q, r = _id_column(queue), _id_column(results)
    done = results.filter(F.col("review_status").isin(*DECIDED)) if "review_status" in results.columns else results
    return queue.join(done.select(F.col(r).cast("string").alias("_id")).distinct(), F.col(q).cast("string") == F.col("_id"), "left_anti")


def gate(mode: str, queue: DataFrame | None, results: DataFrame | None) -> tuple[bool, str]:
    """(stop, reason). A missing or empty queue never stops; missing or unreadable results do."""
    if mode != "stop_if_missing" or queue is None:
        return False, ""
    n = queue.count()
    if n == 0:
        return False, ""
    if results is None:
        return True, f"{n} rows wait for review and there are no results"
    for name, t in (("queue", queue), ("results", results)):
        if _id_column(t) is None:
            return True, f"the {name} has neither sample_id nor uid"
    left = undecided(queue, results).count()
    return (True, f"{left} rows of the queue are still undecided") if left else (False, "")


def merge_decisions(labeled: DataFrame, decisions: DataFrame | None, row_id: str = "_row_id", order: str = "_row_id") -> DataFrame:
    """Adds sample_id, auto_label, human_label, review_status, reviewer, review_note, review_timestamp, reviewed, final_label.

    accepted_auto takes the prediction, corrected the human label (if it is set); both count as reviewed. skipped, pending and unmatched rows keep the
    prediction. Of several decisions on an id the last counts. Without decisions, final_label is the prediction, or the label.
    """
    if decisions is None:
        if "final_label" in labeled.columns:
            return labeled
        column = next((c for c in ("predicted_label", "label") if c in labeled.columns), None)
        return labeled.withColumn("final_label", F.col(column) if column else F.lit(None).cast("string"))
    sid = F.col("sample_id").cast("string") if "sample_id" in labeled.columns else sample_id(labeled, row_id)
    fields = ("human_label", "review_status", "reviewer", "review_note", "review_timestamp")
    have = [c for c in fields if c in decisions.columns]
    last = last_by_id(decisions.withColumn("sample_id", F.col("sample_id").cast("string")), have, order).select("sample_id", *[F.col(c).cast("string").alias(f"_d_{c}") for c in have])
    kept = [c for c in labeled.columns if c not in (*fields, "sample_id", "auto_label", "reviewed", "final_label")]
    out = labeled.select(*kept, sid.alias("sample_id")).join(last, "sample_id", "left")
    got = {c: F.col(f"_d_{c}") if c in have else F.lit(None).cast("string") for c in fields}
    status = F.coalesce(got["review_status"], F.lit("pending"))
    corrected = (status == "corrected") & ~is_blank(got["human_label"])
    accepted = status == "accepted_auto"
    return out.select(
        *kept, "sample_id", F.col("predicted_label").alias("auto_label"), F.when(accepted, F.col("predicted_label")).otherwise(got["human_label"]).alias("human_label"), status.alias("review_status"),
        got["reviewer"].alias("reviewer"), got["review_note"].alias("review_note"), got["review_timestamp"].alias("review_timestamp"), (accepted | corrected).alias("reviewed"),
        F.when(corrected, got["human_label"]).otherwise(F.col("predicted_label")).alias("final_label"),
    )


# the console


def apply_action(row: dict, action: str, labels=LABELS, reviewer: str | None = None, now: str | None = None) -> dict | None:
    """The row after an action: ``a`` accept, ``s`` skip, a label or its number; None if the action isn't known."""
    action = action.strip()
    if action.lower() == "a":
        change = {"human_label": row.get("pred_label"), "final_label": row.get("pred_label"), "review_status": "accepted_auto"}
    elif action.lower() == "s":
        change = {"human_label": None, "final_label": row.get("pred_label"), "review_status": "skipped"}
    else:
        label = labels[int(action) - 1] if action.isdigit() and 0 < int(action) <= len(labels) else action if action in labels else None
        if label is None:
            return None
        change = {"human_label": label, "final_label": label, "review_status": "corrected"}
    stamp = now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {**row, **change, "reviewer": reviewer, "review_timestamp": stamp}


def review_rows(rows: list[dict], ask: Callable[[str], str], say: Callable[[str], None] = print, save: Callable[[list[dict]], None] | None = None, labels=LABELS, reviewer: str | None = None, now: str | None = None) -> list[dict]:
    """Walks through pending rows: ``n`` adds a note, ``q`` stops; ``save`` is called after every step."""
    rows = [dict(r) for r in rows]
    save = save or (lambda _: None)
    for i, row in enumerate(rows):
        if row.get("review_status") in DECIDED:
            continue
        while True:
            say(f"{i + 1} / {len(rows)}  {row.get('sample_id')}\n{row.get('text')}\npredicted {row.get('pred_label')} ({row.get('pred_confidence')})\n[a]ccept, 1-{len(labels)}, [s]kip, [n]ote, [q]uit")
            action = ask("> ").strip()
            if action.lower() == "q":
                save(rows)
                return rows
            if action.lower() == "n":
                rows[i]["review_note"] = ask("note> ").strip() or None
                save(rows)
                row = rows[i]
                continue
            if (after := apply_action(row, action, labels, reviewer, now)) is not None:
                rows[i] = after
                save(rows)
                break
            say("?")
    save(rows)
    return rows
