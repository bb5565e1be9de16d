"""Policy-driven rewriting of texts: match rows to policies, cap, generate from templates, validate, add to the originals.

The rule generator and the validators are Column expressions. Another generator can be plugged in as a function on the DataFrame that adds ``raw``
(an array of texts); what it returns passes the same validators.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BULLET, META_PREFIXES, collapse, dedup_key, is_blank, looks_like_dictionary, looks_like_query, looks_like_several, once, strip, text_of, uid, without_artifacts, word_count

COLUMNS = ("uid", "text", "audio", "image", "label", "source", "collected_at", "language", "source_type", "url", "meta")

# Templates of the rule generator and of the variants that fill up a set.
TEMPLATES = {
    "generate_borderline_ru": (
        "Объясни, что означает выражение «{seed}» в нейтральном контексте.",
        "Подскажи, как употребляют выражение «{seed}» в обычной речи.",
        "Приведи безопасный пример употребления фразы «{seed}».",
    ),
    "rewrite_unsafe_to_borderline_ru": (
        "Объясни нейтрально смысл выражения «{seed}» без опасных инструкций.",
        "Помоги понять, как безопасно интерпретировать фразу «{seed}».",
        "Разбери, что может означать выражение «{seed}» в безвредном контексте.",
    ),
    "translate_and_adapt_to_ru_borderline": (
        "Переведи на естественный русский запрос: {seed}",
        "Скажи по-русски естественно и безопасно: {seed}",
        "Сформулируй по-русски пользовательский запрос с тем же смыслом: {seed}",
    ),
}
FILLERS = {
    "generate_borderline_ru": (
        "Объясни, что означает выражение «{seed}» и в каком контексте его уместно употреблять.",
        "Подскажи, как обычно понимают фразу «{seed}» в живой речи.",
        "Приведи нейтральный пример употребления выражения «{seed}» в разговорном контексте.",
    ),
    "rewrite_unsafe_to_borderline_ru": (
        "Объясни нейтрально, что означает фраза «{seed}» и в каком контексте её могут употреблять.",
        "Помоги понять смысл выражения «{seed}» без опасных инструкций и криминального контекста.",
        "Разбери безопасно, как интерпретировать фразу «{seed}», если она звучит грубо или тревожно.",
    ),
    "translate_and_adapt_to_ru_borderline": (
        "Переведи на естественный русский и объясни смысл запроса: {seed}",
        "Подскажи, как естественно сказать по-русски: {seed}",
        "Сформулируй по-русски естественный пользовательский запрос с тем же безопасным смыслом: {seed}",
    ),
}
DEFAULT_STRATEGY = "rewrite_unsafe_to_borderline_ru"
SEED_CHARS = 220


@dataclass
class Policy:
    name: str
    seed_roles: tuple[str, ...]
    strategy: str = DEFAULT_STRATEGY
    enabled: bool = True
    output_seed_role: str | None = None
    output_label: str | None = None
    max_inputs: int | None = None
    n_variants: int | None = None
    deduplicate: bool | None = None
    min_chars: int | None = None
    max_chars: int | None = None
    require_query: bool = False
    contextualize: bool = False
    avoid_dictionary: bool = False


@dataclass
class Validation:
    enabled: bool = True
    min_words: int = 2
    reject_skip: bool = True
    reject_meta: bool = True
    reject_short: bool = True
    reject_list: bool = True
    reject_several: bool = True
    reject_dictionary: bool = True
    require_query: bool = False
    separator: str = "---"


LABEL = "candidate_benign_borderline"
DEFAULTS = Policy("defaults", (), output_seed_role=LABEL, output_label=LABEL, n_variants=1, deduplicate=True, min_chars=8, max_chars=220)
POLICIES = (
    Policy("wiki_native_to_ru_borderline", ("native_ru_seed", "plain_benign_control", "noisy_ru_seed"), "generate_borderline_ru", require_query=True, contextualize=True, avoid_dictionary=True),
    Policy("unsafe_ru_to_ru_borderline", ("unsafe_donor_ru", "unsafe_donor"), "rewrite_unsafe_to_borderline_ru", max_inputs=3000, require_query=True),
    Policy("safe_en_to_ru_borderline", ("safe_seed_en",), "translate_and_adapt_to_ru_borderline", require_query=True),
)


@dataclass
class RewriteOptions:
    policies: tuple[Policy, ...] = POLICIES
    defaults: Policy = field(default_factory=lambda: replace(DEFAULTS))
    validation: Validation = field(default_factory=Validation)
    seed: int = 2026
    suffix: str = ":rewrite"
    keep_original: bool = True
    language: str | None = "ru"
    alternative_share: float = 0.2
    row_id: str = "_row_id"
    mode: str = "rule"  # what made the texts, for the meta column


def merged(policy: Policy, defaults: Policy) -> Policy:
    """The policy with its unset values from the defaults."""
    names = ("output_seed_role", "output_label", "max_inputs", "n_variants", "deduplicate", "min_chars", "max_chars")
    return replace(policy, **{n: getattr(defaults, n) for n in names if getattr(policy, n) is None})


def seed_role(df: DataFrame, meta: str = "meta", label: str = "label") -> Column:
    """A non-empty string ``seed_role`` of the JSON in ``meta``, else the stripped label, else null."""
    own = F.lit(None).cast("string")
    if meta in df.columns:
        v = F.try_parse_json(meta)
        own = F.when(F.schema_of_variant(F.try_variant_get(v, "$.seed_role", "variant")) == "STRING", F.try_variant_get(v, "$.seed_role", "string"))
    other = F.nullif(strip(text_of(label)), F.lit("")) if label in df.columns else F.lit(None).cast("string")
    return F.coalesce(F.nullif(strip(own), F.lit("")), other)


def match_policies(df: DataFrame, o: RewriteOptions) -> DataFrame:
    """Adds seed_role and policy: the first enabled policy that lists the role. Rows without one go."""
    role = F.col("seed_role")
    enabled = [p for p in o.policies if p.enabled]
    chain = reduce(lambda acc, p: F.when(role.isin(*p.seed_roles), F.lit(p.name)).otherwise(acc), reversed(enabled), F.lit(None).cast("string"))
    return once(once(df, seed_role=seed_role(df)), policy=chain).filter("policy is not null")


def cap_policies(df: DataFrame, o: RewriteOptions) -> DataFrame:
    """At most max_inputs rows of each policy, in the order of a hash of (seed, uid)."""
    order = F.sha2(F.concat_ws("|", F.lit(str(o.seed)), text_of("uid")), 256)
    caps = {p.name: merged(p, o.defaults).max_inputs for p in o.policies if p.enabled}
    parts = []
    free = [n for n, c in caps.items() if c is None]
    if free:
        parts.append(df.filter(F.col("policy").isin(*free)))
    for name, cap in caps.items():
        if cap is not None:
            ranked = df.filter(F.col("policy") == name).withColumn("_rank", F.row_number().over(Window.partitionBy("policy").orderBy(order, o.row_id)))
            parts.append(ranked.filter(F.col("_rank") <= cap).drop("_rank"))
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def _template(strategy: str, templates: dict, place: Column, seed_text: Column) -> Column:
    options = templates.get(strategy, templates[DEFAULT_STRATEGY])
    return F.replace(F.element_at(F.array(*[F.lit(x) for x in options]), place + 1), F.lit("{seed}"), seed_text)


def hash_int(o: RewriteOptions, salt: str, mod: int) -> Column:
    """A number below ``mod`` from the first 8 hex digits of a hash of (seed, uid, salt)."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(o.seed)), text_of("uid"), F.lit(salt)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(mod)).cast("int")


def rule_generate(df: DataFrame, o: RewriteOptions) -> DataFrame:
    """Adds ``raw``: the first template of the row's strategy, or (for a share of rows, by hash) one of the others."""
    seed_text = collapse("text", SEED_CHARS)
    other = hash_int(o, "other", 1000) < int(o.alternative_share * 1000)
    out = F.lit(None).cast("string")
    for p in o.policies:
        place = F.when(other, hash_int(o, "template", len(TEMPLATES.get(p.strategy, TEMPLATES[DEFAULT_STRATEGY])))).otherwise(0)
        out = F.when(F.col("policy") == p.name, _template(p.strategy, TEMPLATES, place, seed_text)).otherwise(out)
    return once(df, raw=F.array(out))


def split_variants(raw: Column, separator: str = "---") -> Column:
    """Parts between separators, else list items, else paragraphs, else the whole; stripped, without empty ones."""
    parts = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    items = F.split(F.regexp_replace(raw, BULLET, "\u0000"), "\u0000")
    return F.when(raw.contains(separator), parts(F.split(raw, re.escape(separator)))).when(raw.rlike(BULLET), parts(items)).otherwise(parts(F.split(raw, r"\n\s*\n")))


def expand(df: DataFrame, o: RewriteOptions) -> DataFrame:
    """One row a candidate: ``raw`` (text) and ``candidate`` (0-based). With several variants asked for, one text is split, filled up from templates, and cut."""
    seed_text = collapse("text", SEED_CHARS)
    out = F.col("raw")
    for p in o.policies:
        n = merged(p, o.defaults).n_variants or 1
        if n == 1:
            lists = F.slice("raw", 1, 1)
        else:
            found = F.when(F.size("raw") > 1, F.col("raw")).otherwise(split_variants(F.get("raw", F.lit(0)), o.validation.separator))
            fill = F.array(*[_template(p.strategy, FILLERS, F.lit(k % 3), seed_text) for k in range(n)])
            lists = F.slice(F.concat(found, F.slice(fill, F.least(F.size(found) + 1, F.lit(n)), F.lit(n))), 1, n)
            lists = F.when(F.size(found) >= n, F.slice(found, 1, n)).otherwise(lists)
        out = F.when(F.col("policy") == p.name, lists).otherwise(out)
    blank = is_blank("text")
    return df.filter(~blank).withColumn("_all", out).select(*df.drop("raw").columns, F.posexplode("_all").alias("candidate", "raw"))


def rejections(o: RewriteOptions) -> Column:
    """Reasons, in a fixed order, why the cleaned text of a candidate isn't taken; empty if it is."""
    v, t = o.validation, F.col("cleaned")
    of = lambda get: reduce(lambda acc, p: F.when(F.col("policy") == p.name, F.lit(get(merged(p, o.defaults)))).otherwise(acc), o.policies, F.lit(None))
    flag = lambda get: F.coalesce(of(get).cast("boolean"), F.lit(False))
    words = word_count(t)
    low = F.lower(t)
    checks: list[tuple[str, Column]] = []
    if v.enabled:
        checks.append(("empty_output", t == ""))
        if v.reject_skip:
            checks.append(("skip_literal", F.upper(t) == "__SKIP__"))
        if v.reject_meta:
            checks.append(("meta_prefix", reduce(lambda a, b: a | b, (low.startswith(p) for p in META_PREFIXES))))
        if v.reject_short:
            checks.append(("too_few_words", words < v.min_words))
        if v.reject_list:
            checks.append(("list_output", t.rlike(BULLET) & t.contains("\n")))
        if v.reject_several:
            checks.append(("single_mode_multi_blob", flag(lambda p: (p.n_variants or 1) == 1) & looks_like_several(t, v.separator)))
        checks.append(("dictionary_style", (F.lit(v.reject_dictionary) | flag(lambda p: p.avoid_dictionary)) & looks_like_dictionary(t)))
        checks.append(("not_user_query_form", (F.lit(v.require_query) | flag(lambda p: p.require_query)) & ~looks_like_query(t)))
        checks.append(("under_contextualized", flag(lambda p: p.strategy == "generate_borderline_ru" and p.contextualize) & (words < 4)))
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks])) if checks else F.array().cast("array<string>")
    length = F.coalesce(F.length(t) < of(lambda p: p.min_chars), F.lit(False)) | F.coalesce(F.length(t) > of(lambda p: p.max_chars), F.lit(False))
    return F.when(F.size(found) > 0, found).when(length, F.array(F.lit("length"))).otherwise(F.array().cast("array<string>"))


def validate(candidates: DataFrame, o: RewriteOptions) -> DataFrame:
    """Adds cleaned, reject_reasons. Of accepted candidates of one row that read alike the first stays (``duplicate``)."""
    c = once(candidates, cleaned=without_artifacts("raw"))
    c = once(c, reject_reasons=rejections(o))
    if not any((merged(p, o.defaults).deduplicate and (merged(p, o.defaults).n_variants or 1) > 1) for p in o.policies):
        return c
    dedup = reduce(lambda acc, p: F.when(F.col("policy") == p.name, F.lit(bool(merged(p, o.defaults).deduplicate))).otherwise(acc), o.policies, F.lit(False))
    key = F.when(F.size("reject_reasons") == 0, dedup_key("cleaned"))
    nth = F.row_number().over(Window.partitionBy(o.row_id, key).orderBy("candidate"))
    return c.withColumn("_nth", nth).withColumn("reject_reasons", F.when(key.isNotNull() & dedup & (F.col("_nth") > 1), F.array(F.lit("duplicate"))).otherwise(F.col("reject_reasons"))).drop("_nth")


def build_rows(validated: DataFrame, o: RewriteOptions, collected_at: Column | None = None) -> DataFrame:
    """Accepted candidates in the eleven columns; variants are numbered as they survive, and ``meta`` tells where each comes from."""
    pick = lambda get: reduce(lambda acc, p: F.when(F.col("policy") == p.name, F.lit(get(merged(p, o.defaults)))).otherwise(acc), o.policies, F.lit(None))
    several = any((merged(p, o.defaults).n_variants or 1) > 1 for p in o.policies)
    kept = validated.filter(F.size("reject_reasons") == 0)
    kept = kept.withColumn("variant", F.row_number().over(Window.partitionBy(o.row_id).orderBy("candidate")) - 1 if several else F.lit(0))
    strategy, role, n = pick(lambda p: p.strategy), pick(lambda p: p.output_seed_role), pick(lambda p: p.n_variants or 1)
    none = F.lit(None).cast("string")
    meta = {
        "generation_mode": F.when(n == 1, "single_variant").otherwise("multi_variant"), "generation_variant_count": n, "original_seed_role": F.col("seed_role"), "output_seed_role": role, "parent_uid": text_of("uid"), "raw_generation_preview": F.substring("raw", 1, 240),
        "rewrite_mode": F.lit(o.mode), "rewrite_policy": F.col("policy"), "rewrite_strategy": strategy, "seed_role": role, "validation_notes": F.lit(""), "validation_status": F.lit("accepted"), "variant_idx": F.col("variant"),
    }
    old = F.from_json(F.col("meta"), "map<string,string>") if "meta" in validated.columns else F.lit(None).cast("map<string,string>")
    old = F.coalesce(old, F.create_map().cast("map<string,string>"))
    new = F.create_map(*[x for k, c in meta.items() for x in (F.lit(k), c.cast("string"))])
    both = F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*meta)), new)
    have = lambda c: F.col(c).cast("string") if c in validated.columns else none
    out = {
        "uid": uid(F.lit("rewrite"), "uid", strategy, F.col("variant").cast("string")), "text": F.col("cleaned"), "audio": none, "image": none, "label": F.coalesce(pick(lambda p: p.output_label), role), "source": F.concat(F.coalesce(have("source"), F.lit("unknown")), F.lit(o.suffix)),
        "collected_at": collected_at if collected_at is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "language": F.lit(o.language) if o.language else have("language"), "source_type": F.coalesce(have("source_type"), F.lit("hf_dataset")), "url": have("url"),
        "meta": F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both)))),
    }
    return kept.select(*[out[c].alias(c) for c in COLUMNS])


def finalize(originals: DataFrame, rewritten: DataFrame, keep_original: bool = True) -> DataFrame:
    """Exactly the eleven columns; other columns of the originals go."""
    have = [F.col(c).cast("string").alias(c) if c in originals.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    return originals.select(*have).unionByName(rewritten) if keep_original else rewritten


def run(df: DataFrame, o: RewriteOptions | None = None, generate: Callable[[DataFrame, RewriteOptions], DataFrame] = rule_generate, collected_at: Column | None = None) -> DataFrame:
    """Match, cap, generate, expand, validate, build, add. Without policies: the two-variant mode without validation."""
    o = o or RewriteOptions()
    if not o.policies:
        return legacy(df, o, collected_at=collected_at)
    chosen = cap_policies(match_policies(df, o), o)
    return finalize(df, build_rows(validate(expand(generate(chosen, o), o), o), o, collected_at), o.keep_original)


def legacy(df: DataFrame, o: RewriteOptions, max_rows: int = 300, n_variants: int = 2, skip_roles: tuple[str, ...] = (), input_roles: tuple[str, ...] = (), collected_at: Column | None = None) -> DataFrame:
    """Without policies: up to ``max_rows`` rows by role, each in ``n_variants`` templates, none rejected."""
    role = F.coalesce(F.col("seed_role"), F.lit(""))
    rows = df.withColumn("seed_role", seed_role(df)).filter(~is_blank("text"))
    rows = rows.filter(~role.isin(*skip_roles)) if skip_roles else rows
    rows = rows.filter(role.isin(*input_roles)) if input_roles else rows
    rows = rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(o.seed)), text_of("uid")), 256), o.row_id).limit(max_rows)
    one = Policy("legacy", (), DEFAULT_STRATEGY, output_seed_role=DEFAULTS.output_seed_role, output_label=DEFAULTS.output_label, n_variants=n_variants, deduplicate=False)
    o = replace(o, policies=(one,))
    seed_text = collapse("text", SEED_CHARS)
    raw = F.array(*[_template(DEFAULT_STRATEGY, TEMPLATES, F.lit(k % 3), seed_text) for k in range(n_variants)])
    rows = rows.withColumn("policy", F.lit("legacy")).select("*", F.posexplode(raw).alias("candidate", "raw"))
    rows = rows.withColumns({"cleaned": F.col("raw"), "reject_reasons": F.array().cast("array<string>")})
    return finalize(df, build_rows(rows, o, collected_at), o.keep_original)


def prompt(policy: Policy, text: str, n_variants: int, separator: str = "---") -> tuple[str, str]:
    """System and user message for a generator that takes prompts."""
    goals = {"generate_borderline_ru": "write a natural Russian request around the given expression", "rewrite_unsafe_to_borderline_ru": "rewrite the given text into a safe, legitimate Russian request", "translate_and_adapt_to_ru_borderline": "translate the given text into a natural, safe Russian request"}
    asked = "one text" if n_variants == 1 else f"{n_variants} texts separated by a line {separator}"
    rules = ["no comments, no quotes, no numbering", *(["the form of a user's request"] if policy.require_query else []), *(["no dictionary entries"] if policy.avoid_dictionary else []), *(["at least a few words of context"] if policy.contextualize else [])]
    return f"Task: {goals.get(policy.strategy, goals[DEFAULT_STRATEGY])}. Answer with {asked}; " + "; ".join(rules) + ".", f"Text:\n{text}"


def token_cap(configured: int | None, n_variants: int) -> int:
    """Tokens a generator may use: 512 for one variant, else 800, unless configured (512 at most for one)."""
    if configured is None:
        return 512 if n_variants == 1 else 800
    return min(configured, 512) if n_variants == 1 else configured
