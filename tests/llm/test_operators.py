"""The training-data operators against brute-force versions, and in their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import bpe, html, lattice, media, mixing, registry, shards, simhash, substring, toxicity, warc
from keyloom.llm.common import Workspace, components, np_components, small_reads, spread, table

LINES = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, fp int, h double, key string, top int, start int, h2 int"


def docs_of(spark, texts):
    """Texts under clashing extra columns; a text may be (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 0.5, "k", 2, 3, 4) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    base = words(rng, 300)
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (3, 100, 250)]
    shared = " ".join(words(rng, 60))
    return [None, "", " \t\n", "one", "one", "One", "two words", " ".join(base), *near, " ".join(base), " ".join(base).upper(),
            *[" ".join(words(rng, 30)) + " " + shared + " " + " ".join(words(rng, rng.randrange(40))) for _ in range(12)],
            "again " * 200, "ünïcode ß 日本 " * 30, " ".join(words(rng, 20000)), (7, "seven twice"), (None, " ".join(base)), (None, "alone")]


def test_spread_only_where_partitions_are_few(spark):
    few, many = spark.range(10).coalesce(1), spark.range(0, 10, 1, 7)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(many) is many


# ---- components ----

def test_components_of_any_shape(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(400)]
    loose = [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    edges = chain + star + loose + loose
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(spark, df, Workspace(spark, "t")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    real = [e for e in edges if e[0] != e[1]]
    want = np_components(len(nodes), [at[a] for a, _ in real], [at[b] for _, b in real])
    assert set(got) == set(nodes)
    groups, mine = defaultdict(set), defaultdict(set)
    for x in nodes:
        groups[want[at[x]]].add(x)
        mine[got[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert components(spark, df.limit(0), Workspace(spark, "t")).count() == 0


# ---- 1 ----

def brute_simhash(rows, k, radius):
    prints = [simhash.majority(simhash.shingle_hashes((t or "").encode(), k)) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    label = np_components(len(rows), [a for a, _ in links], [b for _, b in links])
    least = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, label)), key=str)


@pytest.mark.parametrize("hot", [None, 2])
def test_simhash_matches_brute_force(spark, odd_texts, hot):
    df = docs_of(spark, odd_texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, hot=hot).collect()), key=str)
    assert got == brute_simhash(rows, 4, 4)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_rows_grow_in_proportion(spark, monkeypatch):
    """Nodes with very many fingerprints go on down the trie: each row is dealt a bounded number of times, and no pair is lost."""
    rng = np.random.default_rng(6)
    prints = rng.integers(-(1 << 62), 1 << 62, 60_000, dtype=np.int64)
    near = prints[:300].copy()
    for i in range(300):
        for b in rng.choice(62, rng.integers(1, 5), replace=False):
            near[i] ^= np.int64(1 << int(b))
    every = np.unique(np.concatenate((prints, near)))
    df = spark.createDataFrame([(int(p),) for p in every], "node long").withColumn("fp", F.col("node"))
    dealt = {}
    grid = simhash.dealt_as_grid
    for hot in (4096, 8):
        sizes = []
        monkeypatch.setattr(simhash, "dealt_as_grid", lambda rows, h, ws, counts=None: (sizes.append((rows.count(), rows.groupBy("top").count().agg(F.max("count")).first()[0])), grid(rows, h, ws, counts))[1])
        got = {(r.a, r.b) for r in simhash.links(df, Workspace(spark, "t"), 4, 5, hot=hot).collect()}
        dealt[hot] = sizes[0]
        at = {int(p): i for i, p in enumerate(every)}
        roots = np_components(len(every), [at[a] for a, _ in got], [at[b] for _, b in got])
        assert all(roots[at[int(a)]] == roots[at[int(b)]] for a, b in zip(prints[:300], near))
        assert len(set(roots.tolist())) == len(every) - 300
    assert dealt[4096][0] == 5 * len(every) and dealt[8][0] <= 25 * len(every) and dealt[8][1] <= 8


def test_simhash_on_dense_groups(spark):
    """Many fingerprints within few bits of each other, searched through tries of every block."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    prints = list(centre)
    for c in centre[:5]:
        for _ in range(60):
            p = int(c)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                p ^= 1 << int(b)
            prints.append(np.uint64(p))
    prints = np.unique(np.array(prints, np.uint64))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "node long").withColumn("fp", F.col("node"))
    for radius, blocks, hot in ((4, 5, None), (4, 5, 3), (9, 5, None), (9, 5, 40), (10, 4, None), (0, 5, None)):
        ws = Workspace(spark, "t")
        got = {r.a: r.b for r in simhash.links(df, ws, radius, blocks, hot=hot).collect()} and simhash.links(df, ws, radius, blocks, hot=hot).collect()
        at = {int(p): i for i, p in enumerate(prints.view(np.int64))}
        mine = np_components(len(prints), [at[r.a] for r in got], [at[r.b] for r in got])
        d = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
        i, j = np.nonzero(np.triu(d, 1))
        assert (mine == np_components(len(prints), i, j)).all(), (radius, blocks, hot)


# ---- 2 ----

@pytest.mark.parametrize("hot", [None, 5])
def test_near_duplicates_are_exact_around_the_threshold(spark, hot):
    """Pairs of similarity 0.75 to 0.85, and stars whose copies differ from one another."""
    import corpus_pipeline as c

    rng, texts = random.Random(11), [None, "", "one two", "One  two"]
    for n in range(150):
        base = words(rng, rng.choice([60, 104, 304]), 10**6)
        more = list(base)
        cut = round(len(base) * (1 / (0.75 + 0.1 * n / 149) - 1))
        texts += [" ".join(base), " ".join(more + words(rng, cut, 10**6))]
    star = words(rng, 100, 10**6)
    texts += [" ".join(star[:k] + [f"x{k}"] + star[k + 1 :] + [f"y{k}"]) for k in range(0, 100, 5)]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    want = np_components(len(texts), [i for i, _ in near], [j for _, j in near]).tolist()
    assert 50 < len([i for i, x in enumerate(want) if i != x]) < 160
    found = simhash.near_duplicates(docs_of(spark, texts), c.SHINGLE, c.RADIUS, c.BLOCKS, c.CHECKS, c.CHECK_BITS, c.SEARCHED, hot, c.SIMILARITY)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == want


def toxic_corpus(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = words(rng, rng.randrange(20, 80), 300)
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vileness", "vilest", "wretched"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.scored(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.95


def test_toxicity_does_not_read_held_out_labels(spark):
    docs, labels = toxic_corpus(spark, 200)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    wrong = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.scored(docs, x).collect()) for x in (labels, wrong))
    assert a == b


def brute_kneser_ney(texts, toxic):
    """{letters: log ratio} of every n-gram and context, by plain recursion over counts of both classes."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    own, inside = [Counter(), Counter()], set()
    for text, bad in zip(texts, toxic):
        for w in toxicity._words((text or "").lower()):
            s = f"^{w}$"
            own[not bad].update(s[max(0, i - order + 1) : i + 1] for i in range(1, len(s)))
            inside |= {s[i:j] for i in range(len(s)) for j in range(i + 2, min(len(s), i + order) + 1)}
    count = Counter(y[1:] for y in inside)

    def shared(g):
        if not g:
            return 1 / len([x for x in count if len(x) == 1])
        after = [n for h, n in count.items() if len(h) == len(g) and h[:-1] == g[:-1]]
        return (count[g] - d) / sum(after) + d * len(after) / sum(after) * shared(g[1:])

    def saved(counts, ctx):
        after = [n for h, n in counts.items() if h[:-1] == ctx]
        return (sum(after), d * len(after) / sum(after)) if after else (0, 1.0)

    out = {}
    for g in set(own[0]) | set(own[1]):
        p = []
        for counts in own:
            n, left = saved(counts, g[:-1])
            p.append((max(counts[g] - d, 0) / n if n else 0) + left * shared(g[1:]))
        out[g, 0] = np.log(p[0] / p[1])
        out[g[:-1], 1] = np.log(saved(own[0], g[:-1])[1] / saved(own[1], g[:-1])[1])
    return out


def test_toxicity_model_matches_brute_force(spark):
    """Every probability of the table, and the scores of words seen, half seen and not seen."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("aab cdé", k=rng.randrange(5, 60))) for _ in range(60)] + [None, "", "!?"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    ws = Workspace(spark, "t")
    rows = toxicity.with_labels(docs, labels, ws)
    learnt = [(r.text, r.toxic) for r in rows.collect()]
    want = brute_kneser_ney([t for t, _ in learnt], [x for _, x in learnt])
    got = {np.int64(r.h).view(np.uint64): r.full for r in toxicity.ratios(toxicity.gram_counts(rows), ws).collect()}
    value = {}
    for (g, context), v in want.items():
        n, ctx, _ = toxicity.hashes(toxicity.codes(" " * toxicity.ORDER + g + "a" * context))
        value[(ctx if context else n)[-1]] = v
    assert set(got) == set(value) and all(abs(got[h] - v) < 1e-4 for h, v in value.items())

    keys = np.array(sorted(got), np.uint64)
    model = toxicity.Sent(keys, np.array([got[h] for h in keys], np.float32))
    asked = [*(t or "" for t, _ in learnt), "ab ab zz", "zzzzzz aab", "c" * 30]
    for text, scores in zip(asked, toxicity.word_scores([toxicity.stream(t) for t in asked], model)):
        sums = []
        for w in toxicity._words(text.lower()):
            s = f"^{w}$"
            contexts = [(s[max(0, i - toxicity.PAD) : i], s[i]) for i in range(1, len(s))]
            sums.append(sum(want.get((ctx + c, 0), want.get((ctx, 1), 0.0)) for ctx, c in contexts))
        assert np.allclose(scores, sums, atol=1e-3)


def test_toxicity_is_the_same_however_the_model_travels(spark, monkeypatch):
    docs, labels = toxic_corpus(spark, 200)
    docs = docs.unionByName(docs_of(spark, [(900, None), (901, "x " * 3000)]))
    want = sorted(tuple(r) for r in toxicity.scored(docs, labels).collect())
    monkeypatch.setattr(toxicity, "SENT_GRAMS", 10)
    assert sorted(tuple(r) for r in toxicity.scored(docs, labels).collect()) == want
    monkeypatch.setattr(toxicity, "PIECE", 50)
    monkeypatch.setattr(toxicity, "COUNTED", 100)
    monkeypatch.setattr(toxicity.Stored, "stretch", 1000)
    assert sorted(tuple(r) for r in toxicity.scored(docs, labels).collect()) == want


def test_toxicity_edges(spark):
    docs, labels = toxic_corpus(spark, 100)
    extra = docs.unionByName(docs_of(spark, [(900, None), (901, ""), (None, "wretched"), (902, "x " * 30000)]))
    got = toxicity.scored(extra, labels.union(spark.createDataFrame([(3, None, 1), (None, 1, 1)], labels.schema))).collect()
    assert len(got) == 104 and all(r.score is not None for r in got)
    assert all(r.score == 0 and r.predicted == 0 for r in toxicity.scored(docs, labels.limit(0)).collect())
    assert toxicity.scored(docs.limit(0), labels).count() == 0


# ---- 3 ----

LONG = "This is one of the long texts that we have, and it is here for all of you to see what is in it, as it was in the days when all that was so, and that is how it is and will be for as long as it can, with all of it in the place where it was and will be. "


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"),
    ("<article><h1>A &amp; B</h1><p>x&nbsp; y\n z<p>1 &lt; 2<br>next</article><footer>no</footer>", "A & B\n\nx y z\n\n1 < 2 next"),
    ("<head><title>t</title></head><body><nav><a>m</a></nav><main>in<script>var a='<p>';</script> side<style>p{}</style></main><aside>x</aside>", "in side"),
    ("<article>a<div class='comments'><p>c</p></div><div class=ad>buy</div><form>f<input></form>b</article>", "a\n\nb"),
    ("<article><p><b>un<i>closed <p>next</article><p>after", "unclosed\n\nnext"),
    ("<article>a<!-- c -- > d --> b <!-- open", "a b"),
    ("<article>tail", "tail"),
    ("<article><ul><li><a href=x>one</a><li><a href=y>two</a><li><a href=z>three</a></ul><p>" + LONG + "</article>", LONG.strip()),
    (f"<div id=menu><a href=/>Home</a></div><div><h2>Head</h2><p>{LONG}<p>short<p>{LONG}</div><div class='sidebar'>{LONG}</div><p>&copy; x",
     f"Head\n\n{LONG.strip()}\n\nshort\n\n{LONG.strip()}"),
    ("<article>" + "w " * 50000 + "</article>", ("w " * 50000).strip()),
    ("<article class='no-sidebar'>kept</article>", "kept"),
    ("<article><p hidden>h</p><p style='display:none'>n</p>seen</article>", "seen"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


def without_landmarks(page):
    for name in ("article", "main"):
        page = page.replace(f"<{name}>", "<div>").replace(f"</{name}>", "</div>")
    return page


def test_densities_find_the_article(spark, data):
    """Pages whose article is not marked: blocks are told by densities and neighbours alone."""
    right = wanted = given = 0
    for r in table(spark, data, "pages").collect():
        a, b = (Counter(html.main_text(p).split("\n\n")) for p in (r.html or "", without_landmarks(r.html or "")))
        right, wanted, given = right + sum((a & b).values()), wanted + sum(a.values()), given + sum(b.values())
    assert right >= 0.95 * wanted and right >= 0.95 * given


PROSE = "zorv quel bramt ostik plum vaner dolt misk orben talv skerm unt prok valdi mern " * 4
PAGES = [
    # stop words tell text from lists of names, where no place is marked
    (f"<div><p>{LONG}<p>{PROSE}<p>{LONG}</div>", [LONG, LONG]),
    # a language whose words nobody lists: long blocks of few links are the text
    (f"<div><p>{PROSE}<p>{PROSE}x<p><a href=x>{PROSE}</a></div>", [PROSE, PROSE + "x"]),
    (f"<article><p>{PROSE}<p>short<p>{LONG}</article>", [PROSE, "short", LONG]),
    # short blocks go with the nearer neighbour
    (f"<div><p>{LONG}<p>near<p>also<p>far<p><a href=x>{PROSE}</a><p>beyond<p><a href=x>{PROSE}</a></div>", [LONG, "near", "also"]),
    # a list of sources between text stays, a menu at the edge goes
    (f"<article><p>{LONG}<ul><li><a href=x>one</a><li><a href=y>two</a><li><a href=z>three</a></ul><p>{LONG}</article>", [LONG, "one", "two", "three", LONG]),
    (f"<article><p>{LONG}<p>see <a href=x>this source here</a></article>", [LONG, "see this source here"]),
    ("<p title='x > y' data=\"<div>\">a</p><p x='>b</p>", ["a", "b"]),
]


@pytest.mark.parametrize("page, texts", PAGES)
def test_block_rules(page, texts):
    assert html.main_text(page) == "\n\n".join(t.strip() for t in texts)


@pytest.mark.parametrize("piece", ["<a \"", "<p a='", "<script>", "<!--", "<a ", "<div>", "</div>", "<a \"'", "<style><body>", "<", "<!", "&#", "<p a=\"x\" ", "<li><b>"])
def test_scanning_is_linear(piece):
    """Unclosed quotes, tags and scripts cost no more than other characters."""
    import time

    for tail in ("", ">", "\">", "'>\"", "</a>text"):
        start = time.process_time()
        html.main_text(piece * (400_000 // len(piece)) + tail)
        assert time.process_time() - start < 6


def test_extraction_of_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article>a</article>", "x", 9), (1, "u", "<article>a</article>", "x", 9), (None, None, None, "y", 9)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, html.extracted(df).collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html.extracted(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp!-&;= \"'article", max_size=80))
def test_extraction_never_fails(page):
    assert isinstance(html.main_text(page), str)


# ---- 4 ----

def test_shards(spark, odd_texts):
    df = docs_of(spark, odd_texts)
    got = shards.byte_shards(df).collect()
    rows = df.collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows if r.doc_id is not None)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    assert [r.shard for r in order] == sorted(r.shard for r in got)  # contiguous
    assert shards.byte_shards(df.limit(0)).count() == 0


def test_shards_balance(spark):
    df = docs_of(spark, ["x" * (i * 37 % 200) for i in range(4000)])
    size = Counter()
    for r in shards.byte_shards(df).collect():
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * 201


# ---- 5 ----

def test_media_round_trip(spark, odd_texts):
    df = docs_of(spark, odd_texts)
    got = defaultdict(list)
    for r in media.media_columns(df).collect():
        got[r.doc_id].append(r)
    for r in df.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert want in [(x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got[r.doc_id]]
    same = {}
    for rows in got.values():
        for r in rows:
            assert same.setdefault(r.payload_sha256, tuple(r)[2:]) == tuple(r)[2:]
    assert media.media_columns(df.limit(0)).count() == 0


def test_media_members_and_headers(spark):
    import tarfile

    df = docs_of(spark, ["a" * 100, "a" * 100, "b", None]).coalesce(1)
    ws = Workspace(spark, "t")
    index = media.pack(df, ws.folder("x"), ws)
    rows = index.collect()
    assert len({(r.path, r.offset) for r in rows}) == 3
    names = []
    for path in {r.path for r in rows}:
        with tarfile.open(path.removeprefix("file://").removeprefix("file:")) as t:
            names += t.getnames()
    assert sorted(names) == sorted({f"{r.digest}.png" for r in rows})
    assert {(r.width, r.height, r.bits) for r in media.with_headers(index).collect()} == {(64, 1, 8), (64, 2, 8)}


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_media_has_one_place_for_a_payload(spark, monkeypatch, bits):
    """Copies over many partitions, and a payload larger than a shard."""
    monkeypatch.setattr(media, "BLOOM_BITS", bits)
    monkeypatch.setattr(media, "SHARD_BYTES", 3000)
    rng = random.Random(3)
    texts = ["copy"] * 40 + [None, "", "copy\0"] + ["".join(rng.choices("abcdefgh", k=20_000))] * 2 + [f"text {i}" for i in range(30)]
    df, ws = docs_of(spark, texts).repartition(9), Workspace(spark, "t")
    index = media.pack(df, ws.folder("x"), ws)
    places = defaultdict(set)
    for r in index.collect():
        places[r.digest].add((r.path, r.offset))
    # a text and the same text with a byte 0 behind it have one payload; they may be packed apart
    own = hashlib.sha256(media.padded(b"copy")).hexdigest()
    assert all(len(p) == 1 for d, p in places.items() if d != own) and len(places[own]) <= 2
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in media.read_back(index).collect())
    assert got == Counter((i, len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for i, t in enumerate(texts))


@given(st.binary(max_size=2000))
@settings(max_examples=50, deadline=None)
def test_png_is_lossless(raw):
    assert media.from_png(media.to_png(media.padded(raw))).tobytes() == media.padded(raw)


# ---- 6 ----

def brute_links(rows, least):
    def fit(r):
        return r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)

    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if fit(rows[i]) and fit(rows[j]) and rows[i].label == rows[j].label and len(rows[i].embedding) == len(rows[j].embedding)
             and np.dot(rows[i].embedding, rows[j].embedding) / np.linalg.norm(rows[i].embedding) / np.linalg.norm(rows[j].embedding) >= least]
    return links


@pytest.mark.parametrize("hot", [2048, 3])
def test_lattice_matches_brute_force(spark, hot):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(60):
        c = rng.standard_normal(64)
        for _ in range(rng.integers(1, 6)):
            rows.append((k, (c + rng.standard_normal(64) * 0.04 * np.linalg.norm(c) / 8 * rng.integers(0, 4)).tolist(), int(k % 2)))
            k += 1
    rows += [(1000, [1.0, 0.0], 1), (1001, [1.0, 0.0], 1), (1001, [1.0, 0.0], 1), (1002, [0.0, 0.0], 1), (1003, None, 1), (1004, [float("nan"), 1.0], 1), (1005, [1.0, None], 1),
             (1006, [1.0, 0.0], None), (1007, [float("inf"), 0.0], 1), (1008, [], 1), (1009, [1e-30, 0.0], 1), (1010, [-0.0, 1.0], 1), (1011, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label int, node int, v double")
    data = df.collect()
    links = brute_links(data, 0.98)
    n_links = Counter(x for p in links for x in p)
    label = np_components(len(data), [a for a, _ in links], [b for _, b in links])
    least = {}
    for r, g in zip(data, label):
        least[g] = min(least.get(g, r.vec_id), r.vec_id)
    want = sorted((r.vec_id, n_links[i], least[g], r.vec_id == least[g]) for i, (r, g) in enumerate(zip(data, label)))
    got = sorted(tuple(r) for r in lattice.near_duplicates(df, hot=hot).collect())
    assert len(got) == len(want) and all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(got, want))
    recall = sum(a[1] for a in got) / sum(a[1] for a in want)
    assert sum(a[1] for a in want) > 100 and recall >= 0.97, recall
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2048, 5])
def test_lattice_on_chains_and_dense_groups(spark, hot):
    """A chain whose ends are far apart, and a group in which all are near: links are counted once each."""
    rng = np.random.default_rng(4)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    rows = [(i, (np.cos(i * 0.15) * a + np.sin(i * 0.15) * b).tolist(), 1) for i in range(20)]
    centre = rng.standard_normal(64)
    rows += [(100 + i, (centre + rng.standard_normal(64) * 0.01).tolist(), 2) for i in range(60)] + [(300, rows[0][1], 1), (301, rows[0][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(df, hot=hot).collect()}
    n_links = Counter(rows[x][0] for p in brute_links(df.collect(), 0.98) for x in p)
    assert all(got[100 + i] == (59, 100) for i in range(60))
    assert all(got[i][0] <= n_links[i] for i in range(20)) and sum(got[i][0] for i in range(20)) >= 0.9 * sum(n_links[i] for i in range(20))
    assert got[301] == (0, 301) and got[300][1] == 0


def test_e8_points():
    v = lattice.shortest()
    assert len(v) == 240 and np.allclose((v * v).sum(1), 2)
    x = np.random.default_rng(1).standard_normal((500, 8)) * 2
    p = lattice.nearest_e8(x)
    doubled = np.rint(2 * p).astype(int)
    assert (np.ptp(doubled % 2, axis=1) == 0).all() and (np.rint(p.sum(1)).astype(int) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    assert (d <= ((x[:, None] - p[:, None] - v) ** 2).sum(2).min(1) + 1e-9).all() and d.max() <= 1 + 1e-9


# ---- 7 ----

def water(children, budget):
    """{name: share} by filling up step by step."""
    left, out, open_ = budget, {}, {n: (w, c) for n, (w, c) in children.items() if w > 0}
    while open_ and left > 1e-9:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c <= left * w / total + 1e-9]
        if not full:
            out |= {n: left * w / total for n, (w, _) in open_.items()}
            break
        for n in full:
            out[n] = open_[n][1]
        left -= sum(open_.pop(n)[1] for n in full)
    return out


@pytest.mark.parametrize("share, epochs", [(0.5, 1), (0.9, 1), (1.0, 3), (5.0, 2), (0.0, 1)])
def test_mixing_budgets(spark, share, epochs):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice("ab"), rng.choice(["s", "s", "s", "t", None])) for i in range(900)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_tokens_old int")
    weights = [{"a": 3.0, "b": 1.0}, {"s": 1.0, "t": 5.0}]
    got = mixing.mixed(df, {"lang": F.col("lang"), "source": F.col("source")}, weights, share=share, max_epochs=epochs).collect()
    have, taken = Counter(), Counter()
    for r in got:
        have[r.lang, r.source or ""] += r.n_tokens
        taken[r.lang, r.source or ""] += r.n_tokens * r.epochs
    langs = water({x: (weights[0][x], epochs * sum(v for k, v in have.items() if k[0] == x)) for x in "ab"}, share * sum(have.values()))
    for x in "ab":
        goal = water({k[1]: (weights[1].get(k[1], 1.0), epochs * v) for k, v in have.items() if k[0] == x}, langs.get(x, 0))
        for k in {k[1] for k in have if k[0] == x}:
            assert goal.get(k, 0) - 30 <= taken[x, k] <= goal.get(k, 0) + 1e-6
    assert len(got) == 900 and max(r.epochs for r in got) <= epochs
    assert max(r.epochs for r in got) - 0 >= 0 and all(r.epochs >= 0 for r in got)


@pytest.mark.parametrize("range_rows, step_bits", [(1024, 10), (1, 10), (1, 3), (4, 1)])
def test_mixing_takes_the_prefix_of_the_hash_order(spark, monkeypatch, range_rows, step_bits):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(mixing, "STEP_BITS", step_bits)
    rng = random.Random(9)
    df = docs_of(spark, [" ".join(["w"] * rng.randrange(0, 9)) for _ in range(700)]).withColumn("source", F.when(F.col("doc_id") < 600, "hot").otherwise("cold"))
    got = mixing.mixed(df, {"source": F.col("source")}, [{"hot": 2.0, "cold": 1.0}], share=1.6, max_epochs=3, seed=5).collect()
    whole = {s: min(r.epochs for r in got if r.source == s) for s in ("hot", "cold")}
    h = {r.doc_id: tuple(r)[1:] for r in spark.range(700).select(F.col("id").alias("doc_id"), *[F.xxhash64("id", F.lit(5), F.lit(n).cast("long")) for n in range(4)]).collect()}
    every = sum(r.n_tokens for r in got)
    have = {s: sum(r.n_tokens for r in got if r.source == s) for s in whole}
    goal = water({s: (w, 3 * have[s]) for s, w in (("hot", 2.0), ("cold", 1.0))}, 1.6 * every)
    for s in whole:
        rest, taken = int(goal[s]) - whole[s] * have[s], set()
        assert int(goal[s]) // have[s] == whole[s]
        for r in sorted((r for r in got if r.source == s), key=lambda r: h[r.doc_id][whole[s]] % 2**64):
            rest -= r.n_tokens
            if rest < 0:
                break
            taken.add(r.doc_id)
        assert {r.doc_id for r in got if r.source == s and r.epochs > whole[s]} == (taken if int(goal[s]) % have[s] else set())


def test_mixing_edges(spark):
    df = docs_of(spark, [None, "", "a b", (5, "c d e"), (5, "c d e")])
    out = mixing.mixed(df, {"lang": F.col("lang")}, [None], share=1.0)
    assert {r.doc_id: r.epochs for r in out.collect()} == {0: 1, 1: 1, 2: 1, 5: 1} and set(df.columns) < set(out.columns)
    assert mixing.mixed(df.limit(0), {"lang": F.col("lang")}, [None]).count() == 0
    clash = df.selectExpr("doc_id", "text", "lang", "1 as whole", "2 as rest", "3 as h", "4 as part", "5 as n_tokens", "6 as epochs", "7 as tokens", "8 as budget", "9 as target")
    assert sorted((r.doc_id, r.epochs, r.whole) for r in mixing.mixed(clash, {"lang": F.col("lang")}, [None], share=1.0).collect()) == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (5, 1, 1), (5, 1, 1)]
    one, two = (sorted((r.doc_id, r.epochs) for r in mixing.mixed(docs_of(spark, ["w"] * 100), {"lang": F.col("lang")}, [None], share=0.5, seed=s).collect()) for s in (1, 2))
    assert sum(e for _, e in one) == sum(e for _, e in two) == 50 and one != two


def test_mixing_counts_words_as_the_pattern_does(spark):
    rng = random.Random(12)
    signs = [*"abx$\\ \t\n\x0b\x0c\r \x1c\x85\xa0", "\u3000", "\u2028", "é", "\U0001f600", "\0"]
    texts = [None, "", " ", " x", "x \r\n", "w " * 100000, "w" * 500000, " " * 500000, *["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.n_words(F.col("text")).alias("n"))
    assert [r.n for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_small_reads_end_with_the_block(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), small_reads(spark, 7):
        assert spark.conf.get(key) == "7"
        raise ValueError
    assert spark.conf.get(key) == before


def test_op7_counts_words_once(spark, data):
    got = registry.op7_mixing(spark, data)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan and "regexp" not in plan
    docs, levels = table(spark, data, "documents"), {"domain": registry.domain(), "lang": F.col("lang"), "source": F.col("source")}
    want = mixing.mixed(docs, levels, [registry.DOMAIN_WEIGHTS, None, None], share=1.0, max_epochs=2)
    want = want.select("doc_id", registry.domain().alias("domain"), "lang", "source", "n_tokens", "epochs")
    assert got.dtypes == want.dtypes and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


# ---- 8 ----

def text_key(t):
    """The 64 bits that order the texts of one doc_id, signed."""
    return (simhash.xxhash.xxh64_intdigest(t, 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def brute_substring(rows, window=20):
    """Sorted results of the rows with a doc_id; repeated rows are one document, other texts of a doc_id documents of their own."""
    seen, found = {}, {}
    rows = [(i, text_key(t or ""), t or "") for i, t in rows if i is not None]
    for i, key, t in sorted(set(rows)):
        w = t.encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[p : p + window]), (i, key, p)) != (i, key, p):
                gone |= set(range(p, p + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        found[i, key] = (i, len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return sorted(found[i, key] for i, key, _ in rows)


def substring_rows(df):
    return sorted(tuple(r) for r in substring.digests(df).collect() if r.doc_id is not None)


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_matches_brute_force(spark, odd_texts, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_ANCHOR", hot)
    t = " ".join(f"t{i}" for i in range(45))
    u = " ".join(f"u{i}" for i in range(45))
    again = [(100, t), (101, "z " + t), (101, u), (102, t), (102, t), (103, u + " " + t + " " + u), (103, "a " + t), (103, "b " + t)]
    df = docs_of(spark, [*odd_texts, *again])
    assert substring_rows(df) == brute_substring([(r.doc_id, r.text) for r in df.collect()])
    assert all(r.n_removed == 0 for r in substring.digests(df).collect() if r.doc_id is None)
    assert substring.digests(df.limit(0)).count() == 0


def test_substring_keeps_the_other_text_of_an_id(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(45)) for c in "tu")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.digests(docs_of(spark, [(1, t), (2, t), (2, u)])).collect())
    assert got == [(1, 45, 0), (2, 45, 0), (2, 45, 45)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.digests(docs_of(spark, [(1, t), (2, "z " + t), (2, u)])).collect())
    assert got == [(1, 45, 0), (2, 45, 0), (2, 46, 45)]


def test_substring_one_phrase_in_many_contexts(spark, monkeypatch):
    """A frequent phrase is dealt out by windows: no task gets all its places, and the result is the same."""
    rng = random.Random(12)
    phrase = " ".join(f"p{i}" for i in range(14))
    texts = [" ".join(words(rng, 12, 3) + [phrase] + words(rng, 12, 3)) for _ in range(1500)]
    df = docs_of(spark, texts)
    want = brute_substring(list(enumerate(texts)))
    assert sum(r[2] for r in want) > 10_000 and substring_rows(df) == want
    sizes = []
    settle = substring.settle
    monkeypatch.setattr(substring, "settle", lambda rows, w, k: (sizes.append(rows.where("words is not null").groupBy("h").count().agg(F.max("count")).first()[0]), settle(rows, w, k))[1])
    monkeypatch.setattr(substring, "HOT_ANCHOR", 50)
    assert substring_rows(df) == want and (sizes[0] or 0) <= 50


@pytest.mark.parametrize("seed", range(4))
def test_substring_on_small_alphabets(spark, seed):
    """Few words, so that windows repeat in every way."""
    rng = random.Random(seed)
    parts = [[rng.choice("abcde") for _ in range(rng.randrange(15, 45))] for _ in range(6)]
    texts = [" ".join(x for _ in range(rng.randrange(1, 6)) for x in rng.choice(parts)) for _ in range(40)]
    df = docs_of(spark, texts)
    assert substring_rows(df) == brute_substring(list(enumerate(texts)))


def test_substring_without_bloom(spark, odd_texts, monkeypatch):
    df = docs_of(spark, [t for t in odd_texts if not isinstance(t, tuple)])
    want = sorted(map(tuple, substring.digests(df).collect()))
    monkeypatch.setattr(substring, "BLOOM_BITS", 8)
    assert sorted(map(tuple, substring.digests(df).collect())) == want


# ---- 9 ----

def test_warc_records(spark):
    big, huge = "x" * 1500, "é" * 200_000
    rows = [(1, "u", big), (5, "u\r\n1", big), (3, None, big), (None, "v", big), (9, "z", ""), (10, "z", None), (11, "q", "a" * 999), (12, "q", "a" * 999), (13, "h", huge), (14, "h", huge), (14, "h", huge), (20, "ü/?q=%20#f", "é" * 500)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")
    got = sorted((tuple(r) for r in warc.archived(df).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        revisit = len(raw) >= 1000 and i != max(ids)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_chunks(spark):
    text = "".join(chr(65 + i % 26) for i in range(5000))
    df = spark.createDataFrame([(1, "http://a/b c", text), (2, None, "")], "page_id long, url string, html string")
    ws = Workspace(spark, "t")
    paths = [r.path for r in warc.write(df, ws.folder("w"), ws).collect()]
    rows = sorted(warc.read(spark, paths, chunk=999).collect(), key=lambda r: (r.page_id, r.chunk_no))
    one = [r for r in rows if r.page_id == 1]
    assert b"".join(bytes(r.data) for r in one).decode() == text and [r.chunk_no for r in one] == list(range(6))
    sha = hashlib.sha1()
    for r in one:
        sha.update(bytes(r.data))
        assert r.sha1_so_far == sha.hexdigest() and r.is_last == (r.chunk_no == 5)
    assert one[0].url == "http://a/b%20c" and rows[-1].url is None and rows[-1].bytes_so_far == 0


# ---- 10 ----

@pytest.fixture(scope="module")
def tokenizers():
    t = bpe.tokenizer(LINES, public_tokenizers.PATTERN)
    return t, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_bpe_is_tiktoken(tokenizers, text):
    mine, theirs = tokenizers
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text) and mine.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeéñß ", min_size=1, max_size=40), st.text(alphabet="abcdeéñß ", max_size=10), st.integers(0, 40), st.integers(0, 10))
def test_prefix_tables_follow_edits(tokenizers, text, put, at, removed):
    v = tokenizers[0].vocabulary
    raw = text.encode()
    t = bpe.PrefixTable(v, raw)
    assert [v.tokens[i] for i in t.ids()] == v.merged(raw)
    at = min(at, len(raw))
    t.edit(at, min(removed, len(raw) - at), put.encode())
    new = raw[:at] + put.encode() + raw[at + min(removed, len(raw) - at) :]
    assert t.raw == new and [v.tokens[i] for i in t.ids()] == v.merged(new)
    t.append(b"xyz")
    assert [v.tokens[i] for i in t.ids()] == v.merged(new + b"xyz")


def test_edits_stop_where_the_old_table_is_met(tokenizers):
    rng = random.Random(7)
    v = tokenizers[0].vocabulary
    raw = "".join(rng.choices("abcde fghi", k=30_000)).encode()
    t = bpe.PrefixTable(v, raw)
    for at, removed, put in ((15_000, 3, b"xyz"), (10, 0, b"added"), (20_000, 500, b""), (0, 1, b""), (29_000, 1, b"\xff\xfe")):
        before = t.computed
        t.edit(at, removed, put)
        raw = raw[:at] + put + raw[at + removed :]
        assert t.raw == raw and t.last == bpe.PrefixTable(v, raw).last
        assert t.computed - before <= len(put) + 4 * v.longest


def test_bpe_rows(spark, odd_texts, tokenizers, monkeypatch):
    df = docs_of(spark, odd_texts)
    want = sorted(((r.doc_id, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
                   for r in df.collect() for i in [tokenizers[1].encode_ordinary(r.text or "")]), key=str)
    assert sorted(map(tuple, bpe.digests(df, LINES, public_tokenizers.PATTERN).collect()), key=str) == want
    assert bpe.digests(df.limit(0), LINES, public_tokenizers.PATTERN).count() == 0
    rows = bpe.encoded(df, LINES, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in rows) == sorted((r.doc_id or -1, (r.text or "").encode()) for r in df.collect())


def test_bpe_forgets(tokenizers, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    t = bpe.Tokenizer(tokenizers[0].vocabulary, public_tokenizers.PATTERN)
    for text in ["some words here and more", "other words here", "some words", "x" * 100 + " words"] * 2:
        assert t.encode(text) == tokenizers[1].encode_ordinary(text)


# ---- queries and pipeline ----

@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_cover_their_tables(spark, data, name):
    n = registry.QUERIES[name](spark, data).count()
    whole = {"op3_html": "pages", "op9_warc": "pages", "op6_lattice": "embeddings"}.get(name, "documents")
    assert n == table(spark, data, whole).count()


def test_pipeline_stages(spark, data):
    import corpus_pipeline as c

    ws, docs = Workspace(spark, "t"), table(spark, data, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in c.STAGES:
        docs = ws.save(stage(spark, docs, data), "x")
        if name != c.STAGES[-1][0]:
            assert docs.columns == c.COLUMNS
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= set(before)
    last = docs.collect()
    assert last and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_pipeline_stages_in_odd_cases(spark, data, odd_texts):
    import corpus_pipeline as c

    odd = docs_of(spark, odd_texts).select(*c.COLUMNS)
    for docs in (odd, odd.limit(0)):
        for _, stage in c.STAGES:
            out = Workspace(spark, "t").save(stage(spark, docs, data), "x")
            assert out.count() <= docs.count()


def test_repeated_rows_stay_once(spark, data):
    import corpus_pipeline as c

    df = docs_of(spark, [(1, "some text of few words"), (1, "some text of few words"), (2, "another text with other words in it"), (3, "some text of few words"), (None, "x"), (None, "x")]).select(*c.COLUMNS)
    out = c.drop_near_duplicates(spark, df, data).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "None", "None"]


def test_pipeline_catches_planted_cases(spark, data):
    import corpus_pipeline as c

    rng = random.Random(9)
    long = words(rng, 400)
    near = long[:200] + ["other"] + long[201:]
    passage = words(rng, 60)
    one, two = words(rng, 50) + passage, passage + words(rng, 50)
    clean = [" ".join(words(rng, 200)) for _ in range(30)]
    df = docs_of(spark, [" ".join(long), " ".join(long), " ".join(near), " ".join(one), " ".join(two), *clean]).select(*c.COLUMNS)
    kept = Workspace(spark, "t").save(c.drop_near_duplicates(spark, df, data), "x")
    assert {r.doc_id for r in kept.collect()} == {0, *range(3, 35)}
    out = {r.doc_id: r.text for r in c.drop_repeats(spark, kept, data).collect()}
    assert out[4] == " ".join(two[60:]) and out[3] == " ".join(one) and all(out[5 + i] == t for i, t in enumerate(clean))
