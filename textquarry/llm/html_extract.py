"""Main text of web pages: mark-up says what is certain, a suffix array over each host's pages decides the rest.

A page is cut into blocks of text, in this order of certainty:
  gone    menus, headers, footers, sidebars, forms, dialogs, scripts, styles: by element, role or ``hidden``;
  prose   inside an ``article`` or ``main`` element (or ``role=main``): kept whole, every block of it;
  doubt   inside an element whose class or id reads like furniture (all its words are in ``HINTS`` or ``PLAIN``, one in ``HINTS``), in the article or on a
          page without one. The name alone decides nothing where the host can tell;
  open    all else on a page without an article. Beside an article, open blocks aren't part of it; they are only evidence.

The host suffix array decides doubt and open blocks. A page's stream holds the words of all its blocks but prose (articles quote each other, and the contract
is to keep that), each block opened by a token for the element around it. The streams of a host's pages are concatenated and their suffixes sorted; the longest
common prefix with a suffix of a different page tells, for each token, the longest run that another page has, too. Tokens in runs of ``MIN_RUN`` or more
are the host's boilerplate and go, unique runs stay. A doubtful block goes whole if its element stands on another page of the host, or the host has no other
page; else only its repeated runs go.

Pages are parsed in place and written; only streams move, by range of (host, hash of page), so a host's whole weight is never in a task. Streams
of at most ``GROUP_TOKENS`` tokens are searched at once. A host that this cuts (by a task's end, or by being larger) has several groups: each sends the
64-bit hashes of its distinct runs of ``MIN_RUN`` tokens, with the stream that holds them, to buckets by hash, is told which of them stand in two different
streams of the host, and covers those too. So the text doesn't depend on where a host is cut. What survives is joined to the pages.

Null html gives an empty text. Cut-off or unbalanced mark-up closes at the end. Character references are decoded in each piece of text between tags. White space
inside a block becomes one space, blocks are joined by one. Pages with the same stream count as one page; repeated rows are extracted alike. Null urls share the
empty host. Very long pages are parsed whole. Columns of the input other than the html are kept; those named text or n_chars are replaced.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, batches, bounded_batches, fresh_names, table, written
from .minhash import U, mix

MIN_RUN = 12
GROUP_TOKENS = 4 << 20
BUCKET_BYTES = 32 << 20  # of streams, for each bucket of runs
FOUND = ("text", "n_chars")
HOST = "\0"  # opens each stream

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav header footer aside form button select datalist menu dialog svg math canvas object audio video map fieldset".split())
MAIN = frozenset(("article", "main"))
#: Closed by the start of one of these.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody")), "th": frozenset(("td", "th", "tr", "tbody")), "option": frozenset(("option", "optgroup"))}
BARRIERS = frozenset("table ul ol dl article section div main body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or id that read like furniture.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs cookie cookies consent gdpr comment comments commentlist disqus replies footer header masthead menu menus nav navbar navigation navigator "
    "newsletter notice notices notification modal overlay pager pagination paywall popup promo promoted promotion related recommended share sharing sidebar sidebars skip social sponsor sponsored sponsors subscribe subscription signup tagcloud toolbar topbar widget widgets".split()
)
#: Words that say nothing beside those.
PLAIN = frozenset("area bar block body bottom box button buttons container content form group holder inner item items left link links list main outer page panel posts right section site slot top unit wrap wrapper".split())
#: Classes that tell what a page has or lacks, not what an element is.
STATES = ("has-", "with-", "no-", "without-", "is-", "js-")


def _like_furniture(value: str) -> str | None:
    """The first name of a class or id that reads like furniture."""
    for name in value.split():
        if not name.lower().startswith(STATES):
            words = set(WORD.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower()))
            if words & HINTS and words <= HINTS | PLAIN:
                return name
    return None


def _region(tag: str, attributes: str, inside_main: bool) -> tuple[str | None, str | None]:
    """gone, main or None (as around it); and what makes the element doubtful."""
    if tag in DROPPED and not (inside_main and tag in ("header", "fieldset")):
        return "gone", None
    doubt = None
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "gone", None
        if key == "role":
            if value.lower() in ROLES:
                return "gone", None
            if value.lower() == "main":
                return "main", None
        if key in ("class", "id") and tag not in ("body", "html", "main") and not doubt:
            name = _like_furniture(value)
            if name and not (inside_main and set(WORD.findall(name.lower())) <= {"header"} | PLAIN):  # an article's own header holds its title
                doubt = f"{tag} {name}"
    return "main" if tag in MAIN else None, doubt


def blocks(html: str) -> list[tuple[str, str, str]]:
    """(main or open, the doubtful element around it or the nearest element, text) of each block with text, in page order; the text has single spaces. The element
    begins with ``?`` if it is doubtful."""
    out: list[tuple[str, str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str, str]] = []  # tag, region, doubtful element
    region, doubt = "open", ""

    def add(piece: str) -> None:
        parts.append(_html.unescape(piece) if "&" in piece else piece)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                tag = next((t for t, _, _ in reversed(stack) if t not in INLINE), "")
                out.append((region, f"?{doubt}" if doubt else tag, text))

    def pop_to(k: int) -> None:
        nonlocal region, doubt
        if any(t not in INLINE for t, _, _ in stack[k:]) or (stack[k - 1][1:] if k else ("open", "")) != (region, doubt):
            flush()
        del stack[k:]
        region, doubt = stack[-1][1:] if stack else ("open", "")

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and region != "gone":
            add(html[at:lt])
        if lt == n:
            break
        m = TOKEN.match(html, lt)
        if m is None:  # a bare <
            if region != "gone":
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                pop_to(k)
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.I).search(html, at)
            if tag == "textarea" or not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        for i in range(len(stack) - 1, -1, -1):
            if tag in CLOSES.get(stack[i][0], ()):
                pop_to(i)
                break
            if stack[i][0] in BARRIERS:
                break
        now, named = _region(tag, m[3], region == "main") if region != "gone" else (None, None)
        if tag not in INLINE or now not in (None, region) or named:
            flush()
        region, doubt = region if region == "gone" else now or region, doubt or named or ""
        if not m[3].endswith("/") or tag not in ("path", "g", "use"):
            stack.append((tag, region, doubt))
    flush()
    return out


def parted(page: list[tuple[str, str, str]]) -> tuple[list[tuple[int, str]], list[tuple[int, str, str]]]:
    """Prose as (place, text), and the blocks of the stream as (place, element, text); place -1: evidence only."""
    article = any(r == "main" for r, _, _ in page)
    prose = [(k, t) for k, (r, e, t) in enumerate(page) if r == "main" and not e.startswith("?")]
    rest = [(k if r == "main" or not article else -1, e, t) for k, (r, e, t) in enumerate(page) if not (r == "main" and not e.startswith("?"))]
    return prose, rest


def stream_of(rest: list[tuple[int, str, str]]) -> list[str]:
    """Words, each block opened by a token for its element."""
    return [HOST, *(w for _, e, t in rest for w in (f"\1{e}", *t.split(" ")))]


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of x (integers) in order, by prefix doubling, and each doubling's ranks: equal for suffixes that share 1, 2, 4, ... tokens."""
    ranks = [np.unique(x, return_inverse=True)[1].astype(np.int64)]
    order, k = np.argsort(ranks[0], kind="stable"), 1
    while len(x) and ranks[-1].max() < len(x) - 1:
        after = np.zeros(len(x), np.int64)
        after[:-k] = ranks[-1][k:] + 1
        key = ranks[-1] * (len(x) + 1) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(x), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        ranks.append(rank)
        k *= 2
    return order, ranks


def common_prefix(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many tokens the suffixes at a and b share."""
    n, out = len(ranks[0]), np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        ok = (x < n) & (y < n)
        ok[ok] = ranks[j][x[ok]] == ranks[j][y[ok]]
        out[ok] += 1 << j
    return out


def matches(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each token, the length of the longest run from it on that stands with another owner, too."""
    if len(x) < 2:
        return np.zeros(len(x), np.int64)
    order, ranks = suffix_array(x)
    lcp = common_prefix(order[:-1], order[1:], ranks)  # of neighbours
    own = owner[order]
    big = np.int64(len(x) + 1)

    def nearest(lcp: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The common prefix with the nearest suffix before it that another owner has: the least since then."""
        change = own[1:] != own[:-1]
        part = np.cumsum(change)  # the smallest of a stretch of one owner, each stretch below the one before
        least = np.minimum.accumulate(lcp - part * big) + part * big
        return np.concatenate([[0], np.where(part > 0, least, 0)])

    best = np.maximum(nearest(lcp, own), nearest(lcp[::-1], own[::-1])[::-1])
    out = np.empty(len(x), np.int64)
    out[order] = best
    return out


def _covered(begins: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, np.minimum(begins + lengths, size), -1)
    return np.cumsum(edge)[:size] > 0


def repeated(streams: list[list[str]], min_run: int = MIN_RUN) -> tuple[list[np.ndarray], set[str]]:
    """For each token stream: which tokens lie in a run of at least ``min_run`` tokens that another, different stream holds too; and the opening tokens that
    stand in two different streams."""
    number: dict[str, int] = {}
    same: dict[tuple[str, ...], int] = {}
    page = [same.setdefault(tuple(s), len(same)) for s in streams]  # equal streams are one page
    x, owner, starts, used = [], [], [], {}
    for p, s in enumerate(same):
        starts.append(len(x))
        x += [number.setdefault(t, len(number)) for t in s]
        owner += [p] * (len(s) + 1)
        x.append(-1 - p)  # ends each page with a token of its own
        for t in {t for t in s if t[:1] in (HOST, "\1")}:
            used[t] = used.get(t, 0) + 1
    length = matches(np.array(x, np.int64), np.array(owner, np.int64))
    at = np.flatnonzero(length >= min_run)
    covered = _covered(at, length[at], len(x))
    return [covered[starts[p] : starts[p] + len(s)] for p, s in zip(page, streams, strict=True)], {t for t, n in used.items() if n > 1}


def survivors(rest: list[tuple[int, str, str]], covered: np.ndarray, shared: set[str]) -> list[tuple[int, str]]:
    """(place, text) of what the host's repeats leave of a page's blocks."""
    out, at = [], 1
    for k, e, t in rest:
        words, opener = t.split(" "), f"\1{e}"
        here = covered[at + 1 : at + 1 + len(words)].tolist()
        at += len(words) + 1
        if k < 0 or e.startswith("?") and (opener in shared or HOST not in shared):
            continue
        if left := " ".join(w for w, c in zip(words, here, strict=True) if not c):
            out.append((k, left))
    return out


def extract_pages(pages: list[list[tuple[str, str, str]]], min_run: int = MIN_RUN) -> list[str]:
    """Main texts of the pages of one host."""
    both = [parted(p) for p in pages]
    repeats, shared = repeated([stream_of(rest) for _, rest in both], min_run)
    return [" ".join(t for _, t in sorted([*prose, *survivors(rest, c, shared)])) for (prose, rest), c in zip(both, repeats, strict=True)]


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def run_hashes(host: str, streams: list[list[str]], min_run: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each stream the hashes of (host, run) for the runs of ``min_run`` tokens that begin at each of its tokens; and those of its opening tokens, 0 elsewhere."""
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(t, len(number)) for t in s), np.int64, len(s)) for s in streams]
    names = np.fromiter(map(_hash, number), np.uint64, len(number))
    opens = np.fromiter((t[:1] in (HOST, "\1") for t in number), bool, len(number))
    top = U(_hash(host))
    alone = np.where(opens, mix(mix(names ^ top) + U(1)) | U(1), U(0))
    runs, single = [], []
    for x in ids:
        n = max(0, len(x) - min_run + 1)
        h = np.full(n, top, np.uint64)
        for i in range(min_run if n else 0):
            h = mix(h ^ names[x[i : i + n]])
        runs.append(h)
        single.append(alone[x])
    return runs, single


def distinct_runs(streams: list[list[str]], hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of a group's runs, and the stream that holds each: its hash, 0 where two different streams do."""
    owners = np.fromiter((_hash(" ".join(s)) | 1 for s in streams), np.uint64, len(streams))
    return _owned(np.concatenate([np.empty(0, np.uint64), *hashes]), np.repeat(owners, [len(h) for h in hashes]))


def _owned(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    last = np.append(first[1:] - 1, len(h) - 1) if len(h) else first
    return h[first], np.where(owner[first] == owner[last], owner[first], U(0))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


STREAM = "_host string, _key bigint, _at array<int>, _elements array<string>, _blocks array<string>"
LEFT = "_key bigint, _at array<int>, _texts array<string>"


def _left(keys: list[int], found: list[list[tuple[int, str]]]) -> pa.Table:
    """Pages with survivors."""
    rows = [(k, [a for a, _ in x], [t for _, t in x]) for k, x in zip(keys, found, strict=True) if x]
    return pa.table({"_key": pa.array([r[0] for r in rows], pa.int64()), "_at": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "_texts": pa.array([r[2] for r in rows], pa.list_(pa.string()))})


def surviving(streams: DataFrame, min_run: int, group_tokens: int, buckets: int) -> DataFrame:
    """``streams``: a row a page (STREAM). Returns the blocks and parts of blocks that the repeats of their hosts leave (LEFT)."""
    rows = streams.withColumn("_tie", F.xxhash64("_key")).repartitionByRange("_host", "_tie").sortWithinPartitions("_host", "_tie").drop("_tie")
    # a row is a page that is done, a page of a group of a host that was cut, or the runs of such a group in a bucket
    kinds = {"_host": pa.string(), "_key": pa.int64(), "_at": pa.list_(pa.int32()), "_elements": pa.list_(pa.string()), "_blocks": pa.list_(pa.string()), "_texts": pa.list_(pa.string()), "_group": pa.string(), "_covered": pa.binary(), "_shared": pa.list_(pa.string()), "_bucket": pa.int64(), "_runs": pa.binary(), "_owners": pa.binary()}
    both = f"{STREAM}, _texts array<string>, _group string, _covered binary, _shared array<string>, _bucket bigint, _runs binary, _owners binary"

    def record(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups = TaskContext.get().partitionId(), 0

        def done(pages: list, h: str, is_cut: bool) -> Iterator[pa.RecordBatch]:
            nonlocal groups
            streams = [stream_of(rest) for _, rest in pages]
            repeats, shared = repeated(streams, min_run)
            if not is_cut:
                t = _left([k for k, _ in pages], [survivors(rest, c, shared) for (_, rest), c in zip(pages, repeats, strict=True)])
                yield record({c: t.column(c).combine_chunks() for c in t.column_names}, len(t))
                return
            name, groups = f"{part}-{groups}", groups + 1
            runs, owners = distinct_runs(streams, [np.concatenate([a, b[b > 0]]) for a, b in zip(*run_hashes(h, streams, min_run), strict=True)])
            home = _bucket(runs, buckets)  # in order, as the runs are
            used, first = np.unique(home, return_index=True)
            for k, i, j in zip(used.tolist(), first, [*first, len(runs)][1:], strict=True):
                yield record({"_group": pa.array([name]), "_bucket": pa.array([k]), "_runs": pa.array([runs[i:j].tobytes()], pa.binary()), "_owners": pa.array([owners[i:j].tobytes()], pa.binary())}, 1)
            for lo in range(0, len(pages), 1000):
                some, bits = pages[lo : lo + 1000], repeats[lo : lo + 1000]
                columns = {"_host": [h] * len(some), "_key": [k for k, _ in some], **{c: [[x[i] for x in rest] for _, rest in some] for i, c in enumerate(("_at", "_elements", "_blocks"))}, "_group": [name] * len(some), "_covered": [np.packbits(x).tobytes() for x in bits], "_shared": [sorted(shared) if i + lo == 0 else None for i in range(len(some))]}
                yield record({c: pa.array(v, kinds[c]) for c, v in columns.items()}, len(some))

        # the first and the last host of a task may go on in another, those between are whole
        pages, held, now, is_cut = [], 0, None, True
        for b in it:
            for h, k, *rest in zip(*(b.column(c).to_pylist() for c in ("_host", "_key", "_at", "_elements", "_blocks")), strict=True):
                if pages and (h != now or held >= group_tokens):
                    is_cut = is_cut or h == now
                    yield from done(pages, now, is_cut)
                    is_cut = is_cut and h == now
                    pages, held = [], 0
                now = h
                pages.append((k, list(zip(*rest, strict=True))))
                held += sum(len(t) for t in rest[2]) // 6 + 1
        if pages:
            yield from done(pages, now, True)

    def told(key, t):
        """Which of the runs that each group sent stand in two different streams, as bits."""
        sent = [np.frombuffer(x, np.uint64) for x in t.column("_runs").to_pylist()]
        h, owner = _owned(np.concatenate(sent), np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("_owners").to_pylist()]))
        bits = [np.packbits(owner[np.searchsorted(h, x)] == 0).tobytes() for x in sent]
        return pa.table({"_group": t.column("_group"), "_bucket": t.column("_bucket"), "_bits": pa.array(bits, pa.binary())})

    def resolve(key, left, right):
        pages = [list(zip(*x, strict=True)) for x in zip(*(left.column(c).to_pylist() for c in ("_at", "_elements", "_blocks")), strict=True)]
        streams = [stream_of(rest) for rest in pages]
        if not pages:
            return _left([], [])
        hashes, single = run_hashes(left.column("_host")[0].as_py(), streams, min_run)
        runs = np.unique(np.concatenate([*hashes, *(x[x > 0] for x in single)]))
        home, hit = _bucket(runs, buckets), np.zeros(len(runs), bool)
        for k, bits in zip(right.column("_bucket").to_pylist(), right.column("_bits").to_pylist(), strict=True):
            i, j = np.searchsorted(home, [k, k + 1])
            hit[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
        shared = {x for y in left.column("_shared").to_pylist() for x in y or ()}
        found = []
        for rest, s, h, o, bits in zip(pages, streams, hashes, single, left.column("_covered").to_pylist(), strict=True):
            begins = np.flatnonzero(hit[np.searchsorted(runs, h)])
            covered = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(s)).astype(bool) | _covered(begins, np.full(len(begins), min_run), len(s))
            opens = np.flatnonzero(o)
            shared |= {s[k] for k in opens[hit[np.searchsorted(runs, o[opens])]].tolist()}
            found.append((rest, covered))
        return _left(left.column("_key").to_pylist(), [survivors(rest, c, shared) for rest, c in found])

    searched = written(rows.mapInArrow(run, both), "streams")
    replies = searched.filter("_bucket is not null").select("_group", "_bucket", "_runs", "_owners").groupBy("_bucket").applyInArrow(told, "_group string, _bucket bigint, _bits binary")
    parts = searched.filter("_group is not null and _bucket is null").select("_group", "_host", "_key", "_at", "_elements", "_blocks", "_covered", "_shared")
    whole = searched.filter("_group is null").select("_key", "_at", "_texts")
    return whole.unionByName(parts.groupBy("_group").cogroup(replies.groupBy("_group")).applyInArrow(resolve, LEFT))


def extract(df: DataFrame, url: str = "url", html: str = "html", min_run: int = MIN_RUN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds text and n_chars (code points); drops the html."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != html and c.lower() not in FOUND]
    host = ascii_lower(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    own = fresh_names(kept)  # the input's columns may have any names
    rows = df.select(*[F.col(c).alias(own[c]) for c in kept], host.alias("_host"), F.monotonically_increasing_id().alias("_key"), F.col(html).alias("_html"))

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            pages = [parted(blocks(t)) if t else ([], []) for t in b.column("_html").to_pylist()]
            needed = [any(k >= 0 for k, _, _ in rest) for _, rest in pages]
            columns = {
                "_prose_at": pa.array([[k for k, _ in prose] if n else None for (prose, _), n in zip(pages, needed, strict=True)], pa.list_(pa.int32())),
                "_prose": pa.array([[t for _, t in prose] if n else [" ".join(t for _, t in prose)] for (prose, _), n in zip(pages, needed, strict=True)], pa.list_(pa.string())),
                "_at": pa.array([[k for k, _, _ in rest] for _, rest in pages], pa.list_(pa.int32())),
                "_elements": pa.array([[e for _, e, _ in rest] for _, rest in pages], pa.list_(pa.string())),
                "_blocks": pa.array([[t for _, _, t in rest] for _, rest in pages], pa.list_(pa.string())),
            }
            names = [c for c in b.schema.names if c != "_html"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *columns.values()], [*names, *columns])

    kinds = T.StructType([f for f in rows.schema.fields if f.name != "_html"] + T.StructType.fromDDL("_prose_at array<int>, _prose array<string>, _at array<int>, _elements array<string>, _blocks array<string>").fields)
    pages = written(rows.mapInArrow(parse, kinds), "pages")
    streams = pages.filter("size(_blocks) > 0").select("_host", "_key", "_at", "_elements", "_blocks")
    size = streams.agg(F.sum(F.aggregate("_blocks", F.lit(0).cast("bigint"), lambda acc, t: acc + F.octet_length(t)))).first()[0] or 0
    left = written(surviving(streams, min_run, group_tokens, max(64, size // BUCKET_BYTES)), "survivors")
    both = pages.drop("_at", "_elements", "_blocks", "_host").join(left, "_key", "left")
    merged = F.array_sort(F.concat(F.arrays_zip(F.col("_prose_at").alias("at"), F.col("_prose").alias("t")), F.arrays_zip(F.col("_at").alias("at"), F.col("_texts").alias("t"))))
    text = F.when(F.col("_texts").isNull(), F.array_join("_prose", " ")).otherwise(F.array_join(F.transform(merged, lambda x: x["t"]), " "))
    return both.select(*[F.col(own[c]).alias(c) for c in kept], text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
