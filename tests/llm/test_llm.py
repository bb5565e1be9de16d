"""Each operator against a brute-force version, SQL, a round trip or held-out labels, and on nulls, empties, ties, repeats and clashing columns."""

import functools
import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import check

from textquarry.llm import binary_ids, components, ctw, decontam, embeddings, html_extract, langid, minhash, spm, toxicity, urlfilter
from textquarry.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, SMALL, QUERIES[name], ORACLES[name])


def odd_docs(spark):
    """Null and empty texts, a null id, repeated rows, and columns named like results."""
    data = [(1, "Alpha beta", 0, "x"), (1, "Alpha beta", 0, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (None, "Gamma ,, delta!", 0, "x"), (5, " \n\t", 0, "x"), (6, "日本語 é " * 3000, 0, "x"), (7, "word " * 20000, 0, "x")]
    return spark.createDataFrame(data, "doc_id bigint, text string, n_words int, score string")


# op1


def test_blocks():
    page = '<body><nav><a>menu</a></nav><div class="cookie-banner">c</div><article><h1>A&amp;B &copy</h1><p>x<b>y</b> z<p>q &lt;t&gt;<form>no</form><ul><li>1<li>2</ul><!-- c --><script>if(a<b)"</p>"</script><section id="comments"><p>hi</p></section> 3 < 4<br>end</article><aside>no</aside><footer>f'
    got = html_extract.blocks(page)
    assert [t for r, e, t in got if r == "main" and e[0] != "?"] == ["A&B ©", "xy z", "q <t>", "1", "2", "3 < 4", "end"]
    assert [(e, t) for _, e, t in got if e[0] == "?"] == [("?div cookie-banner", "c"), ("?section comments", "hi")]
    assert html_extract.blocks("") == [] and html_extract.blocks("<p>a<") == [("open", "p", "a<")]
    assert [t for *_, t in html_extract.blocks("<p hidden>a</p><p>b<div aria-hidden=true>c</div><p class=x>d")] == ["b", "d"]
    assert [t for *_, t in html_extract.blocks("<p>a &am<b>p;</b> &lt<!-- -->; &#233;</p>")] == ["a &amp; <; é"]  # references don't reach over tags


def test_names_alone_decide_nothing(spark):
    """Prose under names that hold a furniture word stays; doubtful elements go if they are the host's, or the host has one page only."""
    prose = '<div class="related-work">earlier studies</div><section id="discussion">we think</section><p class="ad-free">reads well</p>'
    page = lambda i, extra="": f"<article><h1>t{i}</h1>{prose}{extra}</article>"
    data = [(i, "http://many/", page(i, f'<div class="share-box">tell {i}</div>')) for i in range(4)]
    data += [(10, "http://many/", page(10, '<div class="notice">only here</div>')), (11, "http://one/", page(11, '<div class="notice">only here</div>')), (12, "http://one/", page(11, '<div class="notice">only here</div>'))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(data, "page_id bigint, url string, html string")).collect()}
    body = "earlier studies we think reads well"
    assert got == {**{i: f"t{i} {body}" for i in range(4)}, 10: f"t10 {body} only here", 11: f"t11 {body}", 12: f"t11 {body}"}


def brute_repeated(streams, run):
    pages = list(dict.fromkeys(map(tuple, streams)))
    where = {}
    for k, p in enumerate(pages):
        for i in range(len(p) - run + 1):
            where.setdefault(p[i : i + run], set()).add(k)
    out = []
    for s in streams:
        hit = [False] * len(s)
        for i in range(len(s) - run + 1):
            if len(where[tuple(s[i : i + run])]) > 1:
                hit[i : i + run] = [True] * run
        out.append(hit)
    return out


@pytest.mark.parametrize("run", [2, 3, 5, 8, 12])
def test_suffix_array_finds_all_repeats(run):
    r = random.Random(run)
    shared = [r.choice("abcdef") for _ in range(40)]
    streams = []
    for _ in range(9):
        s = [r.choice("abcd") for _ in range(r.randrange(0, 60))]
        k = r.randrange(0, 25)
        streams.append(s + shared[k : k + r.randrange(0, 15)] + [r.choice("abcd") for _ in range(5)])
    streams.append(list(streams[3]))
    assert [x.tolist() for x in html_extract.repeated(streams, run)[0]] == brute_repeated(streams, run)


def test_longest_matches_equal_brute_force():
    r = np.random.default_rng(3)
    for n, top in ((0, 3), (1, 3), (60, 2), (200, 3), (300, 9)):
        x, owner = r.integers(0, top, n), np.sort(r.integers(0, 6, n))
        x = np.where(np.append(owner[1:] != owner[:-1], True), -1 - owner, x) if n else x  # each stretch ends with a token of its own
        want = []
        for i in range(n):
            best = 0
            for j in range(n):
                if owner[i] != owner[j]:
                    k = 0
                    while i + k < n and j + k < n and x[i + k] == x[j + k]:
                        k += 1
                    best = max(best, k)
            want.append(best)
        assert html_extract.matches(x, owner).tolist() == want


def test_pages_without_an_article_lose_what_the_host_repeats():
    frame = "home news about us contact imprint privacy jobs press archive search login help"
    page = lambda i: f"<div>{frame}</div><div>story number {i} {' '.join(random.Random(i).choices(WORDS, k=30))}</div>"
    got = html_extract.extract_pages([html_extract.blocks(page(i)) for i in range(5)])
    assert all("imprint" not in t and f"{i}" in t for i, t in enumerate(got))


def test_extract_equals_article_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in QUERIES["op1_html_extraction"](spark, SMALL).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|<br>|</p>|</?h1>", article))
        assert got[r["page_id"]]["text"] == " ".join(want.split()) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_extract_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t", 7, "a"), (1, None, None, "t", 8, "b"), (2, "http://h/x", "", "t", 9, "c"), (None, "h", "<main>a</main>", "t", None, None)], "page_id bigint, url string, html string, text string, _key bigint, _host string")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "_key", "_host", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["_key"] or 0, r["_host"] or "") for r in got.collect()) == [(0, "a", 1, 0, ""), (1, "", 0, 7, "a"), (1, "", 0, 8, "b"), (2, "", 0, 9, "c")]
    assert html_extract.extract(df.limit(0)).collect() == []
    long = "w " * 400_000
    assert html_extract.extract(spark.createDataFrame([(1, "http://h/", f"<article>{long}</article>")], "page_id bigint, url string, html string")).first()["n_chars"] == len(long) - 1


@pytest.mark.parametrize("group_tokens, partitions", [(4 << 20, 1), (4 << 20, 8), (4 << 20, 32), (60, 1), (60, 3)])
def test_repeats_are_found_wherever_a_host_is_cut(spark, group_tokens, partitions):
    r = random.Random(8)
    say = lambda n: " ".join(r.choices(WORDS + [str(k) for k in range(200)], k=n))
    quotes = [say(15) for _ in range(4)]
    hosts = ["a", "b", "big", "c", "big", "big"]
    kind = lambda: r.choice(["", "", ' class="promo"', f' id="banner-{r.choice("xyz")}"', ' class="ad"'])
    data = [(i, f"http://{r.choice(hosts)}/{i}", "".join(f"<div{kind()}>{x}</div>" for x in (say(r.randrange(0, 30)), r.choice(quotes), say(9)))) for i in range(50)]
    data += [(100 + i, u, h) for i, (_, u, h) in enumerate(data[:12])] + [(200, "http://alone/", data[0][2]), (201, "http://alone/", data[0][2]), (202, "http://big/", None)]
    data += [(300 + i, u, f'<div>{say(3)}</div><article><p>{quotes[0]}</p><div class="ad">{say(9)}</div><p>{say(5)}</p></article>') for i, (_, u, _) in enumerate(data[:20])]
    want = {}
    for name in {u.split("/")[2] for _, u, _ in data}:
        own = [(i, html_extract.blocks(h or "")) for i, u, h in data if u.split("/")[2] == name]
        want |= {i: x for (i, _), x in zip(own, html_extract.extract_pages([p for _, p in own]), strict=True)}
    assert len(set(want.values())) > 40 and all(quotes[0] in want[i] for i in range(300, 320))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = html_extract.extract(spark.createDataFrame(data, "page_id bigint, url string, html string"), group_tokens=group_tokens).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(data) and {x["page_id"]: x["text"] for x in got} == want


# op2


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


def test_scan_equals_brute_force(spark):
    r = random.Random(5)
    say = lambda n: " ".join(r.choices(WORDS[:6], k=n))
    items = [(k, say(r.choice([1, 3, 9, 10, 11, 25]))) for k in range(8)] + [(90, None), (91, "?!"), (92, "Ünï-Code x")]
    texts = [f"{say(r.randrange(0, 8))} {items[r.randrange(8)][1].upper()}, {say(r.randrange(0, 30))}" for _ in range(30)] + [None, "", "ünï code X"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for limit in (1 << 20, 40):  # one block, and several
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], list(x["items"])) for x in decontam.find_contamination(docs, bench, max_block_bytes=limit).collect()}
        assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Zero ONE, two (three) four", 9), (2, "one two", 9), (3, "one two three", 9), (4, None, 9)], "doc_id bigint, text string, n_hit int")
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == [2, 4]
    cut = decontam.decontaminate(docs, bench, mode="spans")
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Zero ) four", 2: "one two", 4: None}
    assert decontam.find_contamination(odd_docs(spark), bench.limit(0)).filter("n_hit > 0").count() == 0


# op3


def test_cascade_is_exact_over_its_universe(spark):
    r = random.Random(2)
    keys = [f"h{r.randrange(10**9)}.example" for _ in range(3000)]
    listed = keys[:400] + ["never.seen"]
    frame = lambda x: spark.createDataFrame([(k,) for k in dict.fromkeys(x)], "key string")
    levels = urlfilter.build_cascade(frame(keys), frame(listed))
    got = {x["key"] for x in frame(keys + listed).filter(urlfilter.listed_by(levels, urlfilter.F.col("key"))).collect()}
    assert got == set(listed) and len(levels) > 1 and sum(x.bits for x in levels) < 40 * len(listed)
    assert urlfilter.build_cascade(frame(keys), frame([])) == []


@pytest.mark.parametrize("max_bytes", [1 << 20, 20])  # one cascade, and several
def test_url_verdicts(spark, max_bytes):
    urls = [None, "no scheme", "https://A.Com", "https://a.com/x", "http://example.com/en/1", "http://www.Example.com/en/1?x", "http://b.net/es/", "http://x.free-bets.example.org/de/", "http://free-bets.example.com/de", "http://notfree-bets.example.org#/en/", "://"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = [tuple(r) for r in urlfilter.filter_urls(df, max_bytes=max_bytes).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "", None, "allow"), ("a.com", "/x", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("b.net", "/es/", "net/es/", "block"), ("x.free-bets.example.org", "/de/", None, "block"), ("free-bets.example.com", "/de", "com/", "allow"), ("notfree-bets.example.org", "", None, "allow"), ("", "", None, "allow"),
    ]
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


# op4


@pytest.fixture(scope="module")
def pieces():
    return spm.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


TEXTS = ["", "Hello world", "  two   spaces\n\n next ", "a ▁ b▁", "x\x00y", "日本語 テスト 😀", "12345,678", " ", "\n", "tail ", "é" * 40, "the " * 50]


def test_plain_bpe_equals_sentencepiece(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [t for t in TEXTS if "▁" not in t]
    got = spm.Encoder(pieces, dropout=0)([""] * len(plain), plain)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [sp.encode(t) for t in plain]


def test_dropout_equals_the_agenda_and_is_lossless(pieces):
    def dropped(key, s, e):
        with np.errstate(over="ignore"):
            h = spm.mix(np.array([key + (s << 32 | e) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]
        return int(h) < int(0.3 * 2.0**64)

    def agenda(run, variant):
        codes = spm._codes([run])
        key, parts = int(spm._keys(1, np.array([variant]), codes)[0]), [(i, i + 1, x) for i, x in enumerate(pieces.symbols(codes)[0].tolist())]
        while True:
            found = [(pieces.rank[j], s, e, j) for (s, m, a), (_, e, b) in zip(parts, parts[1:]) if a >= 0 and b >= 0 and (j := pieces.ids.get(pieces.pieces[a] + pieces.pieces[b])) is not None and not dropped(key, s, e)]
            if not found:
                return [x for *_, x in parts]
            _, s, e, j = min(found)
            parts = [p for p in parts if p[1] <= s] + [(s, e, j)] + [p for p in parts if p[0] >= e]

    runs = [(k % 3, w) for k, w in enumerate([" " + x for x in WORDS] + [" internationalization", "    x", " aaaaaaa"])]
    for (v, w), ids in zip(runs, spm.merge_runs(pieces, [w for _, w in runs], np.array([v for v, _ in runs], np.uint64), 1, 0.3), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == agenda(w, v)
    for dropout in (0, 0.1, 0.9, 1.0):
        coded = spm.Encoder(pieces, 3, dropout)([str(i) for i in range(len(TEXTS))], TEXTS)
        assert [spm.decode(pieces, np.frombuffer(x, "<i4")) for x in coded] == TEXTS
    one, two = (spm.Encoder(pieces, seed, 0.3)(["a", "b", "c", "d"], ["international segmentation"] * 4) for seed in (1, 2))
    assert one == spm.Encoder(pieces, 1, 0.3)(["a", "b", "c", "d"], ["international segmentation"] * 4) and one != two and len(set(one)) > 1


def test_each_occurrence_is_split_anew(pieces):
    code = spm.Encoder(pieces, 5, 0.3)
    one = code(["a"], ["internationalization " * 300])[0]
    assert one == spm.Encoder(pieces, 5, 0.3)(["a"], ["internationalization " * 300])[0] and spm.decode(pieces, np.frombuffer(one, "<i4")) == "internationalization " * 300
    assert len(set(code([str(i) for i in range(200)], ["internationalization"] * 200))) > 4
    occurrences = np.arange(100, dtype=np.uint64)
    assert len(set(code.merged([" internationalization"] * 100, occurrences))) > 4
    # a run of two characters with one merge is split in a share of about the dropout, and two occurrences in one text differ as often as chance has it
    ab = [len(x) // 4 for x in code.merged([" a"] * 4000, np.arange(4000, dtype=np.uint64))]
    assert set(ab) == {1, 2} and abs(ab.count(2) / 4000 - 0.3) < 0.03
    pairs = np.frombuffer(code(["x"], ["a " * 4000])[0], "<i4")
    assert abs((pairs == pieces.ids["a"]).sum() / 4000 - 0.3) < 0.03 and spm.decode(pieces, pairs) == "a " * 4000


def test_encode_odd_rows(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = odd_docs(spark).withColumnRenamed("n_words", "ids")
    got = spm.decoded(spm.encode(docs, model), model).collect()
    assert len(got) == 8 and all(r["decoded"] == (r["text"] or "") and r["n_ids"] == len(r["ids"]) for r in got)
    assert all(r["lossless"] for r in spm.encode(docs, model, lossless="lossless").collect())
    assert spm.encode(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(None, 1), ([], 2), ([3 + 0xE3], 3)], "ids array<int>, decoded int")  # a lone first byte of three
    assert [r["decoded"] for r in spm.decoded(odd, model).collect()] == ["", "", "\ufffd"]


# op5


INSULTS = ["idiot", "moron", "loser", "pathetic"]


def sentences(n, seed):
    r, texts, toxic = random.Random(seed), [], []
    for i in range(n):
        w = ["".join(r.choices(["an", "the", "re", "on", "in", "er", "st", "ou", "ti"], k=r.randrange(1, 4))) for _ in range(r.randrange(5, 60))]
        if i % 4 == 0:
            w.insert(r.randrange(len(w)), r.choice(INSULTS))
        texts.append(" ".join(w).encode())
        toxic.append(int(i % 4 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def machine():
    texts, toxic = sentences(1200, 1)
    return toxicity.fit([toxicity.bag_of(t) for t in texts], toxic)


def test_toxicity_on_held_out_sentences(machine):
    texts, toxic = sentences(400, 2)
    s = machine.score(texts, {})
    assert ((s >= 0.5) == np.array(toxic)).mean() > 0.98 and s.min() >= 0 and s.max() <= 1
    disguised = [b"you id*iot", b"such a m-o-r-o-n", b"what a L0SER", b"i d i o t", b"pathetiic"]
    assert (machine.score(disguised, {}) >= 0.5).all() and (machine.score([None, b"", b" ", b"the restaurant"], {}) < 0.5).all()


def test_folded_kernel_equals_landmark_sum():
    r = random.Random(4)
    words = list({"".join(r.choices("abcde*", k=r.randrange(1, 9))).encode() for _ in range(60)})
    marks = toxicity.Landmarks(words[:20])
    w = np.random.default_rng(0).normal(size=marks.whiten.shape[1] + 1)

    def kernel(a, b):
        def weights(x):
            s, out = b"^" + x, Counter()
            for i in range(len(s)):
                for o, weight in zip(toxicity.OFFSETS, toxicity.WEIGHTS, strict=True):
                    if i + o[-1] < len(s) and all(toxicity.CODE[s[i + k]] for k in o):
                        out[tuple(s[i + k] for k in o)] += weight
            return out, math.sqrt(max(1e-9, sum(weight**2 for i in range(len(s)) for o, weight in zip(toxicity.OFFSETS, toxicity.WEIGHTS, strict=True) if i + o[-1] < len(s) and all(toxicity.CODE[s[i + k]] for k in o))))

        (x, nx), (y, ny) = weights(a), weights(b)
        return sum(v * y[k] for k, v in x.items()) / nx / ny

    by_landmarks = np.array([[kernel(a, b) for b in words[:20]] for a in words]) @ marks.whiten @ w[:-1]
    assert toxicity.linear(words, marks.fold(w)) == pytest.approx(by_landmarks, abs=1e-3)
    assert marks.features(words)[:, :-1] @ w[:-1] == pytest.approx(by_landmarks, abs=1e-3)


def test_toxicity_odd_rows(spark, machine):
    docs = odd_docs(spark).withColumnRenamed("score", "toxic")
    got = toxicity.score_texts(docs, machine).collect()
    assert len(got) == 8 and all(r["toxic"] == 0 and 0 <= r["toxic_score"] < 0.5 for r in got)
    assert [r["toxic_score"] for r in toxicity.score_texts(docs, None).collect()] == [0.0] * 8
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    assert toxicity.learn(docs.drop("toxic"), labels) is None and toxicity.score_texts(docs.limit(0), machine).count() == 0


# op6


def brute_jp(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def packed(d):
    k = sorted(d)
    return np.array(k, np.uint64), np.array([d[x] for x in k])


def test_similarity_and_sketch():
    r, errors = random.Random(1), []
    for _ in range(40):
        a = {i: r.choice([1, 1, 2, 5]) for i in range(r.choice([3, 20, 200]))}
        b = {k: v if r.random() < 0.8 else 3 for k, v in a.items() if r.random() < 0.9} | {1000 + i: 1 for i in range(r.randrange(9))}
        assert minhash.similarity(packed(a), packed(b)) == pytest.approx(brute_jp(a, b))
        shifted = [[minhash.probminhash(minhash.mix(h + np.uint64(k * 7919)), w) for h, w in (packed(a), packed(b))] for k in range(6)]
        errors.append(np.mean([(x == y).mean() for x, y in shifted]) - brute_jp(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def near_copies(seed, n_groups=25, hot=60):
    r, out = random.Random(seed), []
    for g in range(n_groups):
        base = r.choices(WORDS, k=r.randrange(3, 120))
        for _ in range(r.randrange(1, 5)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 30) + 1)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            out.append(" ".join(w))
    base = r.choices(WORDS, k=150)
    for _ in range(hot):  # a large group, each a few words off
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    return out + out[:5] + ["Same, TEXT!", "same text", "", None, ",,"]


@pytest.mark.parametrize("block", [1024, 16])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_copies(7)
    shingle = minhash.Shingler()
    sets = [shingle(decontam.words_of((t or "").encode())) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and minhash.similarity(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.classes(docs).collect()}
    assert got == {i: (find(i), find(i) == i) for i in range(len(texts))}
    kept = sorted(r["doc_id"] for r in minhash.drop_near_duplicates(docs).collect())
    assert kept == [i for i in range(len(texts)) if find(i) == i]


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark)
    assert minhash.classes(docs).count() == 8
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert minhash.classes(docs.limit(0)).count() == 0 and minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_ids_that_are_shared_or_missing_lose_no_link(spark):
    r = random.Random(9)
    a, b, c = (" ".join(r.choices(WORDS, k=150)) for _ in range(3))
    data = [(1, a, 10, "p"), (1, b, 11, "p"), (2, f"{a} x", 12, "p"), (3, f"{b} y", 13, "p"), (None, f"{b} z", 14, "p"), (None, c, 15, "p"), (None, f"{c} x", 16, "p"), (1, a, 17, "p"), (4, None, 18, "p"), (None, None, 19, "p"), (None, "", 20, "p")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, _row int, words string")
    got = [(x["doc_id"], x["class_id"]) for x in minhash.classes(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (None, None), (1, 1), (4, 4), (None, None), (None, None)], key=str)
    for parts in (1, 4):
        out = minhash.drop_near_duplicates(docs.repartition(parts))
        kept = sorted((x["_row"], x["words"], x["text"]) for x in out.collect())
        assert out.columns == docs.columns and all(tuple(data[k - 10][i] for i in (2, 3, 1)) == (k, w, t) for k, w, t in kept)
        found = {k for k, _, _ in kept}
        assert found - {10, 17, 15, 16} == {11, 18, 19, 20} and len(found & {10, 17}) == 1 and len(found & {15, 16}) == 1


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: find(k) for k in root}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# op7


def test_e8_decoder():
    import itertools

    x = np.random.default_rng(1).normal(size=(400, 8)) * 1.5
    points, cost = embeddings.e8_points(x, 3)
    p = points / 2
    assert cost == pytest.approx(((p - x[:, None]) ** 2).sum(2)) and (np.diff(cost, axis=1) >= -1e-9).all()
    whole = (points % 2 == 0).all(2) & (p.sum(2) % 2 == 0)
    half = (points % 2 == 1).all(2) & ((p - 0.5).sum(2) % 2 == 0)
    assert (whole | half).all()
    best = np.full(len(x), np.inf)
    for move in (0, 0.5):
        for d in itertools.product((0, 1), repeat=8):
            q = np.floor(x - move) + np.array(d)
            best = np.where(q.sum(1) % 2 == 0, np.minimum(best, ((q + move - x) ** 2).sum(1)), best)
    assert cost[:, 0] == pytest.approx(best)


@pytest.mark.parametrize("block", [1024, 8])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 64))
    v = [list(map(float, x)) for b in base for x in (b + rng.normal(size=(3, 64)) * rng.uniform(0.1, 0.45))]
    v += [list(map(float, base[0] + rng.normal(size=64) * 0.05)) for _ in range(40)] + [v[0], v[0], [2 * x for x in v[4]]]
    data = [(i, x, 0 if i % 7 else 1) for i, x in enumerate(v)]
    data += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, v[0], None), (904, [], 0), (905, [1.0, 2.0], 0), (906, [1.0, None], 0), (907, v[0], 0), (907, v[0], 0)]
    ok = {k: np.array(x) / np.linalg.norm(x) for k, (_, x, label) in enumerate(data) if x and None not in x and np.isfinite(x).all() and any(x) and label is not None}
    links = {k: {j for j in ok if j != k and data[j][2] == data[k][2] and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= 0.93} for k in ok}

    def reach(k):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(data[j][0] for j in seen)

    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.link_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == sorted((data[k][0], len(links.get(k, ())), reach(k)) for k in range(len(data)))


def test_labels_are_compared_in_full(spark):
    x = [float(k % 5 - 2) for k in range(64)]
    data = [(1, x, "1234567890123456701", 7), (2, x, "1234567890123456702", 7), (3, [2 * v for v in x], "1234567890123456702", 7), (4, x, "", 7), (5, x, None, 7), (6, x, "", 7)]
    got = embeddings.link_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label string, node int")).orderBy("vec_id")
    assert [tuple(r) for r in got.collect()] == [(1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 4, True), (5, 0, 5, True), (6, 1, 4, False)]
    assert embeddings.link_vectors(got.select("vec_id", embeddings.F.array().cast("array<double>").alias("embedding"), embeddings.F.lit("a").alias("label")).limit(0)).count() == 0


@pytest.mark.parametrize("cosine, least", [(0.93, 0.998), (0.94, 0.999), (0.95, 0.9995)])
def test_pairs_at_the_threshold_meet(cosine, least):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 10_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1)[:, None]
    p, r = (embeddings.cells(x, np.zeros(len(x), np.int64)) for x in (a, b))
    assert ((p == r[:, :, :1]).any(2) | (r == p[:, :, :1]).any(2)).any(1).mean() >= least


def test_op7_equals_sql_on_linked_vectors(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 64))
    v = [(list(map(float, x)), k % 3) for k, b in enumerate(base) for x in (b + rng.normal(size=(4, 64)) * rng.uniform(0.1, 0.4))]
    df = spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate([*v, *v[:4]])] + [(900, None, 1), (901, v[0][0], None)], "vec_id bigint, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(embeddings.ORACLE)
    got = QUERIES["op7_embedding_near_dedup"](spark, str(tmp_path)).select(*want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and sum(n > 0 for _, n, *_ in rows) > 60


# op8


def test_language_id_equals_brute_force(spark):
    """Sizes from the library, over texts folded by a regular expression."""
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    dictionaries = langid.learn(docs.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    assert sorted(dictionaries) == sorted({r["lang"] for r in rows if r["lang"]}) and all(0 < len(d) <= langid.DICT_BYTES for d in dictionaries.values())
    got = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        t = re.sub("[\x00-\x60\x7b-\x7f]+", " ", (r["text"] or "").lower()).strip().encode()
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not any(map(str.isalpha, t.decode())):
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            continue
        sizes = {}
        for name, d in dictionaries.items():
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(t[i : i + langid.PIECE])) for i in range(0, len(t), langid.PIECE))
        (best, name), (second, _) = sorted((n, k) for k, n in sizes.items())[:2]
        assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == (name, pytest.approx(1 - best / second))
    with pytest.raises(ValueError):
        langid.learn(docs, max_languages=2)


@pytest.mark.parametrize("parts, size", [([], 9), ([b"abc"], 9), ([b"a" * 50, b"bb", b"c" * 50], 20), ([b"", b"x" * 9], 4)])
def test_dictionary_holds_every_sample(parts, size):
    d = langid.shared_out(parts, size)
    assert len(d) <= size and all(p[:1] in d for p in parts) and (b"bb" in d) == (b"bb" in parts)


def test_language_id(spark):
    r = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "en", "ver"], "cc": ["qué", "ño", "ción", "la"]}
    say = lambda k, n: " ".join("".join(r.choices(syllables[k], k=r.randrange(1, 4))) for _ in range(n))
    train = spark.createDataFrame([(i, say(k, 60), k) for i, k in enumerate(list(syllables) * 20)] + [(None, "x " * 60, "aa"), (99, "y " * 60, None)], "doc_id bigint, text string, lang string")
    dictionaries = langid.learn(train)
    assert set(dictionaries) == set(syllables) and all(len(d) <= langid.DICT_BYTES for d in dictionaries.values())
    test = [(i, say(k, r.randrange(5, 3000)), k) for i, k in enumerate(list(syllables) * 10)]
    docs = spark.createDataFrame(test, "doc_id bigint, text string, lang_pred string")
    got = {x["doc_id"]: x for x in langid.classify(docs, dictionaries).collect()}
    assert all(got[i]["lang_pred"] == k and got[i]["lang_accepted"] and 0 <= got[i]["lang_score"] <= 1 for i, _, k in test)
    odd = langid.classify(spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "zzz")], "doc_id bigint, text string"), dictionaries).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in odd[:3]] == ["und"] * 3 and not any(x["lang_accepted"] for x in odd[:3]) and odd[3]["lang_pred"] in syllables
    assert {x["lang_pred"] for x in langid.classify(odd_docs(spark), {}).collect()} == {"und"} and langid.learn(train.limit(0)) == {}


# op9


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [0, 1, 2**40], sorted(random.Random(1).choices(range(10**7), k=3000)), sorted(random.Random(2).choices(range(50), k=900))])
def test_elias_fano(values):
    ef = binary_ids.EliasFano(binary_ids.ef_encode(np.array(values, np.uint64)))
    assert len(ef) == len(values) and ef.select_range(0, len(values)).tolist() == values and [ef.select(i) for i in range(len(values))] == values
    r = random.Random(len(values))
    for _ in range(30):
        i, j = sorted((r.randrange(len(values) + 1), r.randrange(len(values) + 1)))
        assert ef.select_range(i, j).tolist() == values[i:j]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 1000, 20_000))
    assert len(binary_ids.ef_encode(v)) * 8 < 20_000 * (math.log2(500) + 2.5)


def test_shard_round_trip():
    ids = np.arange(12, dtype="<u2")
    s = binary_ids.Shard(binary_ids.shard_bytes([None, -5, -5, 9], [3, 0, 4, 5], ids.tobytes(), 2))
    assert s.doc_ids(0, 4) == [None, -5, -5, 9] and s.doc_ids(1, 3) == [-5, -5] and s.doc_ids(0, 1) == [None] and [s.tokens(i).tolist() for i in range(4)] == [[0, 1, 2], [], [3, 4, 5, 6], [7, 8, 9, 10, 11]]
    with pytest.raises(ValueError):
        binary_ids.Shard(b"12345678" * 20)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["Hello,  World!\n\nIt's", None, "", "É  x y ́z", "<|endoftext|> a<|startoftext|>", "日本語", "don't\tSTOP 123", "a" * 5000, " "]
    data = [(10 - i, x) for i, x in enumerate(texts)] + [(None, "n"), (3, "again")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    for limit in (1 << 20, 3):
        manifest = binary_ids.write_shards(docs, f"file://{tmp_path}/{limit}", path, max_ids=limit)
        got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"]), r["n_tokens"], r["ids_crc32"]) for r in binary_ids.read_shards(spark, manifest).collect())
        at = 0
        for (key, n, crc) in got:
            assert key[2] == at
            at += n
        want = Counter((i, len(e) + 1, zlib.crc32(np.array([*e, 1], "<u4").tobytes())) for i, x in data for e in [t.encode(x or "", add_special_tokens=False).ids])
        assert Counter((k[1] if k[0] else None, n, c) for k, n, c in got) == want
        assert [k[:2] for k, *_ in got] == sorted(k[:2] for k, *_ in got)
    assert binary_ids.read_shards(spark, binary_ids.write_shards(docs.limit(0), f"file://{tmp_path}/none", path)).count() == 0


def test_runs_encode_as_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, r = Tokenizer.from_file(path), random.Random(1)
    signs = list("aAzZ jJhHtTwWyYİıßſKÅ.,'!1 \n\u1e6f\u030c\u0308\u030a\u0307é日😀\xa0 ")
    texts = ["".join(r.choices(signs, k=r.randrange(0, 40))) for _ in range(3000)] + [None, ""]
    ids, sizes = binary_ids.Encoder(path)(pa.array(texts)[1:])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts[1:]]
    with pytest.raises(ValueError):
        binary_ids.check_width(path, 1, 1)


# op10


@pytest.mark.parametrize("depth", [2, 3, 5, 6])
def test_context_tree_equals_brute_force(monkeypatch, depth):
    monkeypatch.setattr(ctw, "DEPTH", depth)
    r = random.Random(2)
    corpus = [bytes(r.choices(b"abc ", k=r.randrange(0, 40))) for _ in range(6)]
    grams = [Counter() for _ in range(depth + 1)]
    for t in corpus:
        s = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                grams[d][s[i - d : i + 1]] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def counts(ctx, prefix, i):
        n = [0, 0]
        for k, v in grams[len(ctx)].items():
            if k[:-1] == ctx and k[-1] >> (8 - i) == prefix:
                n[(k[-1] >> (7 - i)) & 1] += v
        return n

    kids = lambda ctx: {k[0] for k in grams[len(ctx) + 1] if k[1:-1] == ctx}

    @functools.cache
    def log_w(ctx, *at):
        own = kt(counts(ctx, *at))
        return own if len(ctx) == depth else np.logaddexp(own, sum(log_w(bytes([b]) + ctx, *at) for b in kids(ctx))) - math.log(2)

    def one(full, prefix, i, d=0):
        ctx = full[depth - d :]
        n = counts(ctx, prefix, i)
        e = (n[1] + 0.5) / (sum(n) + 1)
        if d == depth:
            return e
        w = math.exp(kt(n) - log_w(ctx, prefix, i) - math.log(2))
        return w * e + (1 - w) * (one(full, prefix, i, d + 1) if full[depth - 1 - d] in kids(ctx) else 0.5)

    texts = [corpus[0][:15], b"", b"abz", corpus[1]]
    for t, got in zip(texts, ctw.in_memory(corpus, texts), strict=True):
        s, want = b"\xff" * depth + t + b"\xff", 0.0
        for j in range(depth, len(s)):
            for i in range(8):
                p = one(s[j - depth : j], s[j] >> (8 - i), i)
                want += math.log10(p if (s[j] >> (7 - i)) & 1 else 1 - p)
        assert got == pytest.approx(want, rel=1e-5)


def test_probabilities_of_all_bytes_sum_to_one():
    levels, top = ctw.subtrees(*ctw.code_counts([b"abracadabra", b"banana"], [True, True]))
    for context in (b"abrac", b"zzzzz", b"\xff" * 5, b"banan"):
        codes = np.array([int.from_bytes(context + bytes([k]), "big") for k in range(256)])
        assert (10.0 ** ctw.log_probabilities(codes, levels, *ctw.top_nodes(*top)).astype(float)).sum() == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("values", [[], [0], [5, 5, 9, 2**47], list(range(0, 3000, 7))])
def test_packed_codes_round_trip(values):
    x = np.array(values, np.int64)
    assert ctw.unpacked_codes(ctw.packed_codes(x)).tolist() == values and ctw.unpacked(ctw.packed(x)).tolist() == values


@pytest.mark.parametrize("chunk", [12 << 20, 200])
def test_base_scores_equal_brute_force(spark, chunk):
    texts = ["A b  b", None, "", "c\x0bC d", "zz top", "b", "  x"]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "b b"), (0, "A b  b")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    learned = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    c = Counter(w for i, t in data if learned(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or 0, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 9)) for i, t in data)
    got = ctw.score_texts(docs, ctw.crc_mod("doc_id", 7) != 2, chunk_bytes=chunk).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_scores_use_every_context(spark, monkeypatch):
    monkeypatch.setattr(ctw, "FAN", 3)
    r = random.Random(3)
    texts = ["".join(map(chr, r.choices(range(0x4E00, 0x4E00 + 6000), k=400))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = ctw.in_memory([t.encode() for i, t in enumerate(texts) if i % 4], [t.encode() for t in texts])
    for options in ({}, {"chunk_bytes": 4000, "buckets": 7}):
        got = ctw.score_texts(docs, ctw.F.col("doc_id") % 4 != 0, **options).orderBy("doc_id").collect()
        assert [x["score"] for x in got] == pytest.approx(want.tolist(), rel=1e-5)
    assert ctw.score_texts(docs.limit(0), ctw.F.lit(True)).count() == 0
    odd = spark.createDataFrame([(1, "a a", 5.0), (1, "a a", 5.0), (None, None, 5.0), (2, "a " * 50_000, 5.0)], "doc_id bigint, text string, score double")
    for learned in (True, False):
        rows = ctw.score_texts(odd, ctw.F.lit(learned)).collect()
        assert sorted(x["n_tokens"] for x in rows) == [1, 3, 3, 50_001] and all(x["score"] < 0 for x in rows)


def test_scores_beat_the_unigram_base(spark):
    rows = QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.1").filter("held_out").agg(ctw.F.sum("score"), ctw.F.sum("base_score")).first()
    assert rows[0] > rows[1]


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, path = {r["doc_id"]: r["text"] for r in docs.collect()}, f"{tmp_path}/{k}"
        stage(spark, docs, SMALL).write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before.keys() and len(after) > 0.6 * len(before)
        if k < 4:
            assert docs.columns == columns
        if k == 2:
            shingle = minhash.Shingler()
            sets = {i: shingle(decontam.words_of((before[i] or "").encode())) for i in before}
            ids = sorted(before)
            dropped = {max(a, b) for a in ids for b in ids if a < b and minhash.similarity(sets[a], sets[b]) >= 0.8}
            assert before.keys() - after == dropped
        if k == 3:
            assert after == {i for i, t in before.items() if not brute_fast(t, bench)}
        if k == 4:
            assert docs.filter("not lossless").count() == 0 and after == before.keys()


def brute_fast(text, bench):
    """Whether any window of the benchmark occurs, by joined words."""
    joined = " " + " ".join(w.decode() for w in decontam.words_of((text or "").encode())) + " "
    for _, t in bench:
        w = [x.decode() for x in decontam.words_of(t.encode())]
        n = min(10, len(w))
        if any(f" {' '.join(w[k : k + n])} " in joined for k in range(len(w) - n + 1 if w else 0)):
            return True
    return False


def test_digest():
    assert decontam.items_digest({"10", "9"}) == hashlib.sha256(b"10,9").hexdigest()
