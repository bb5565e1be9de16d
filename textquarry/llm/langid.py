"""Language identification by compression: each language has a zstandard dictionary of raw sample text, and a text belongs
to the language whose dictionary compresses it best.

Fitting takes a bounded sample: per language the row with the smallest hash in each of ``samples`` hash slots, and of each up to
``sample_chars`` characters from a place that a hash chooses in the whole text. The dictionary holds of every sample the same number of bytes, or all it has, so
that they come to ``dict_bytes`` together. A text is lower-cased, everything that is no letter becomes one space, and it is
compressed whole, in pieces of ``PIECE`` bytes (a dictionary helps a long text's later parts as much as its first).
margin = 1 - bytes with the best dictionary / bytes with the second best. A text is accepted if it has a letter and its margin
is at least ``min_margin``; rejected texts keep their best guess in lang_pred.

Null texts and texts without a letter: lang_pred ``und``, margin 0, not accepted. Equal sizes: the first language in order of
name. With one language learned the margin is 1; with none everything is ``und``. Rows without an id, a language or a letter aren't learned from; of rows with one id
the least sample is. More than ``max_languages`` different languages are an error, as their dictionaries are broadcast. Repeated rows are judged alike, very long
texts whole. Result columns named as in the input replace them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batches, bounded_batches, crc_mod, table

SAMPLES = 128
SAMPLE_CHARS = 1024
DICT_BYTES = 32 << 10
MAX_LANGUAGES = 1000
PIECE = 4096
LEVEL = 6
MIN_MARGIN = 0.001
FOUND = ("lang_pred", "lang_score", "lang_accepted")
#: ASCII letters, lower-cased, and all bytes from 0x80 stay; all else becomes a space.
FOLD = bytes(i if 0x61 <= i <= 0x7A or i >= 0x80 else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def folded(text: bytes | None) -> bytes:
    """Lower case, single spaces, no ASCII but letters; empty if the text has no letter."""
    if not text:
        return b""
    out = b" ".join(text.decode("utf-8", "replace").lower().encode().translate(FOLD).split())
    if re.search(rb"[a-z]", out) or any(map(str.isalpha, out.decode())):
        return out
    return b""


def shared_out(parts: list[bytes], size: int) -> bytes:
    """The parts joined, each cut to the same length where all of them come to more than ``size`` bytes."""
    parts, low, high = [p for p in parts if p], 0, size
    while low < high:  # the largest length at which they fit
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(len(p), mid) + 1 for p in parts) <= size else (low, mid - 1)
    return b" ".join(p[:low] for p in parts)[:size]


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", samples: int = SAMPLES, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """Raw dictionary of each language. Two passes: ids by partial aggregation, then a part of the texts of at most ``samples`` ids a language."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    rows = docs.filter(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).rlike(r"\p{L}"))
    slots = rows.groupBy(F.col(lang).alias("l"), F.pmod(order, F.lit(samples)).alias("slot")).agg(F.min_by(id_col, order).alias("id"))
    ids = slots.limit(samples * max_languages + 1).collect()
    if len({r["l"] for r in ids}) > max_languages or len(ids) > samples * max_languages:
        raise ValueError(f"there are more than {max_languages} languages")
    if not ids:
        return {}
    start = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - sample_chars + 1)).cast("int") + 1
    got = (
        rows.filter(F.col(id_col).isin(sorted({r["id"] for r in ids})))
        .groupBy(F.col(lang).alias("l"), F.col(id_col).alias("id"))
        .agg(F.min(F.substring(F.col(text), start, F.lit(sample_chars))).alias("t"))
        .collect()
    )
    parts: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["l"], str(r["id"]))):
        parts.setdefault(r["l"], []).append(folded(r["t"].encode()))
    return {k: shared_out(v, dict_bytes) for k, v in sorted(parts.items()) if any(v)}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.names = sorted(dictionaries)
        self.coders = []
        for n in self.names:
            d = z.ZstdCompressionDict(dictionaries[n], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(z.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: bytes | None) -> tuple[str, float]:
        """Language and margin."""
        t = folded(text)
        if not t or not self.names:
            return "und", 0.0
        pieces = [t[i : i + PIECE] for i in range(0, len(t), PIECE)]
        sizes = [sum(len(code(p)) for p in pieces) for code in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=0)
        return self.names[best], (1 - sizes[best] / rest if rest else 1.0)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds lang_pred, lang_score (the margin, 0 to 1) and lang_accepted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*FOUND)
    sent = spark.sparkContext.broadcast(dictionaries)  # at most MAX_LANGUAGES times DICT_BYTES

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for b in batches(it):
            got = [model(t) for t in as_bytes(b.column(text))]
            lang = pa.array([x[0] for x in got], pa.string())
            score = pa.array([x[1] for x in got], pa.float64())
            ok = pa.array([x[0] != "und" and x[1] >= min_margin for x in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, score, ok], [*b.schema.names, *FOUND])

    out = T.StructType([*docs.schema.fields, T.StructField(FOUND[0], T.StringType()), T.StructField(FOUND[1], T.DoubleType()), T.StructField(FOUND[2], T.BooleanType())])
    return docs.mapInArrow(run, out)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = learn(docs.select("doc_id", "text", "lang").filter(~held))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
