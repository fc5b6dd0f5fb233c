"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import html
import html.parser
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomdoc.llm import decontam, graph, htmlmain, license, minhash, packing, quality, substring, tokenbin, tokencount, toxicity

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, u long, key string, spans string, label int"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus():
    r = random.Random(3)
    base = sentence(r, 120)
    passage = sentence(r, 70)
    near = base.split()
    near[60] = "changed"
    rows = [None, "", " \n\t ", "one", base, base, base.upper(), " ".join(near), sentence(r, 40) + " " + passage, passage + " " + sentence(r, 55), "It's <|endoftext|> x\n\n  y é ß 中文 <s>", "In. " * 300, sentence(r, 9000), "a b c\na b c\n\na b c #$% x"]
    out = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}", None, i, "k", "s", i) for i, t in enumerate(rows)]
    return [*out, out[4], (None, base, None, None, None, 0, None, None, None), (None, None, None, None, None, 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().translate(LOW))


@pytest.mark.parametrize(("k", "hot", "partners"), [(2, 50_000, 256), (5, 50_000, 1), (2, 1, 2)])
def test_near_duplicates(docs, none, monkeypatch, k, hot, partners):
    monkeypatch.setattr(minhash, "PARTNERS", partners)
    got = minhash.near_duplicates(docs, minhash.Config(words=k, hot=hot)).collect()
    sets = {}
    for i, t, *_ in corpus():
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
        else:
            assert r.kept
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("hot", "shingles"), [(50_000, 1_000_000), (4, 1500)])
def test_late_links_join_blocks(spark, hot, shingles):
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in r.sample(range(200), 22):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(t.split()) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in range(60):
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = minhash.near_duplicates(df, minhash.Config(words=1, block=7, block_shingles=shingles, hot=hot)).collect()
    assert {x.doc_id: x.component_id for x in got} == comp


def test_near_duplicates_keep_one_row(docs):
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 13] and ids.count(None) == 2


@pytest.mark.parametrize("bar", [1, 3, 256])
def test_components_of_stars_and_paths(spark, monkeypatch, bar):
    monkeypatch.setattr(graph, "HOT_LINKS", bar)
    r = random.Random(bar)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(500 - i, 500) for i in range(1, 30)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)] + [(39, 100), (7, 7)]
    comp = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in comp:
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.label for x in got} == comp and len(got) == len(comp)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_passages(docs, none):
    got = {r.doc_id: r for r in substring.repeated(docs).collect()}
    assert {5, 6, 7, 9} <= set(got) and not {0, 1, 2, 3, 10, 12, 13} & set(got)
    assert got[9].n_removed_words >= 70 and got[8].n_removed_words == 0 and got[5].n_removed_words == 120
    assert substring.repeated(none).count() == 0
    kept = {r.doc_id: r.text for r in substring.deduplicated(docs).select("doc_id", "text").collect()}
    assert kept[8] == corpus()[8][1] and 54 <= len(kept[9].split()) <= 55 and kept[12] == corpus()[12][1]
    assert 4 in kept and not {5, 6, 7} & set(kept) and None in kept


@pytest.mark.parametrize("block", [1, 1_000_000])
def test_repeated_passages_of_lines_that_many_documents_share(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK_WINDOWS", block)
    r = random.Random(11)
    lines = [sentence(r, 7) for _ in range(40)]
    rows = [sentence(r, 60) + " " + line + " " + sentence(r, 60) for line in lines]  # the first holder of each line alone
    for _ in range(6):
        passage = " ".join(r.sample(lines, 9))
        rows += [sentence(r, 30) + " " + passage + " " + sentence(r, r.randint(0, 30)) for _ in range(2)]
        rows.append(passage + " " + sentence(r, 20) + " " + passage)
    rows += [(sentence(r, 1) + " ") * 80] * 2
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    holders = collections.defaultdict(set)
    for i, t in enumerate(rows):
        w = words(t)
        for j in range(len(w) - 49):
            holders[tuple(w[j : j + 50])].add(i)
    every, gone = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in enumerate(rows):
        w = words(t)
        for j in range(len(w) - 49):
            of = holders[tuple(w[j : j + 50])]
            if len(of) > 1:
                every[i].update(range(j, j + 50))
                if i > min(of):
                    gone[i].update(range(j, j + 50))
    got = {x.doc_id: x for x in substring.repeated(df).collect()}
    covered = lambda spans: {v for s in spans or () for v in range(s["begin"], s["end"])}
    assert len(every) == 20
    for i in every:
        assert every[i] <= covered(got[i].spans) and gone[i] <= covered(got[i].removed)


def test_changed_passages_are_found(spark):
    r = random.Random(2)
    rows = []
    for _ in range(6):
        passage = sentence(r, 120).split()
        other = list(passage)
        for p in (25, 55, 90):
            other[p] = "changed"
        del other[70]
        rows += [sentence(r, 40) + " " + " ".join(passage) + " " + sentence(r, 20), sentence(r, 10) + " " + " ".join(other) + " " + sentence(r, 60)]
    rows += [sentence(r, 200) for _ in range(10)]
    got = {x.doc_id: x for x in substring.repeated(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == set(range(12)) and all(110 <= x.n_repeated_words <= 130 for x in got.values())


def test_one_doc_id_on_two_texts(spark):
    r = random.Random(6)
    long = sentence(r, 300)
    rows = [(1, long), (1, sentence(r, 60)), (2, sentence(r, 30) + " " + long), (3, sentence(r, 90))]
    got = {x.doc_id for x in substring.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {1, 2}


@pytest.mark.parametrize("seed", range(8))
def test_chains_against_brute_force_alignment(seed):
    r = random.Random(seed)
    a = np.array([r.randint(0, 10**6) for _ in range(200)], "<u4")
    b = np.concatenate([a[40:90], [1, 2, 3], a[93:160]]).astype("<u4")
    seeds = [(x, y) for x in range(0, 195, 3) for y in range(len(b) - 4) if (a[x : x + 5] == b[y : y + 5]).all()]
    noise = [(r.randint(0, 190), r.randint(0, len(b) - 6)) for _ in range(10)]
    x, y = (np.array(v) for v in zip(*sorted(set(seeds) | set(noise))))
    best = max(substring.chains_of(x, y, substring.Config()), key=len)
    u, v, s, t, n = substring.align(a, b, x[best], y[best], 5)
    assert u <= 43 and v >= 157 and s <= 3 and t >= len(b) - 3 and n >= 110


def test_risk_and_its_gradient_against_plain_loops():
    r = np.random.default_rng(4)
    n, f, prior = 30, 6, 0.3
    x = r.random((n, f)) < 0.4
    rows, cols = np.nonzero(x)
    for shift in (0.0, 3.0):  # with the second one the negative part is below zero
        p, u = np.arange(n) < 12, np.arange(n) >= 8
        w, b = r.normal(size=f) + shift * (x[:12].mean(0) - x[8:].mean(0)) * 4, 0.2

        def risk(w, b):
            plus = minus = 0.0
            for i in range(n):
                z = b + sum(w[j] for j in range(f) if x[i, j])
                plus += prior * (p[i] / p.sum()) * np.log1p(np.exp(-z))
                minus += (u[i] / u.sum() - prior * p[i] / p.sum()) * np.log1p(np.exp(z))
            return plus, minus

        plus, minus, slope = toxicity.risk_parts(p, u, rows, cols, w, b, prior)
        assert np.allclose((plus, minus), risk(w, b))
        aim = (lambda w, b: sum(risk(w, b))) if minus >= 0 else (lambda w, b: -risk(w, b)[1])
        e = 1e-6
        for j in range(f):
            step = np.zeros(f)
            step[j] = e
            assert abs((aim(w + step, b) - aim(w - step, b)) / (2 * e) - slope[x[:, j]].sum()) < 1e-6
        assert abs((aim(w, b + e) - aim(w, b - e)) / (2 * e) - slope.sum()) < 1e-6


def test_toxicity_of_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0), "x") for i in range(12)], "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert collections.Counter(x.doc_id for x in got) == collections.Counter(r[0] for r in corpus()) and all(0 <= x.score <= 1 for x in got)
    assert len({x.score for x in got if x.doc_id == 4}) == 1
    assert toxicity.toxicity(none, labels).count() == 0
    model = toxicity.fit(docs, labels)
    kept = toxicity.rejecting(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x.score < 0.5 for x in got)


def test_unlabelled_text_is_of_all_documents(spark):
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    sample, prior = toxicity._sample(docs, labels, toxicity.Config(max_unlabelled=1000))
    used = {r.text for r in sample.where("u").collect()}
    assert used == {f"word{i}" for i in range(60) if zlib.crc32(str(i).encode()) % 5} and prior == 0.5


def test_toxicity(spark, none):
    r = random.Random(1)
    rows, labels = [(None, None), (100000, ""), (100001, None)], [(None, 1, 1), (100000, 1, None)]
    for i in range(900):
        toxic = i % 7 == 0
        rows.append((i, sentence(r, 30) + (" horrible vermin" if toxic else " ") + sentence(r, 10)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert sum(x.predicted == (x.doc_id % 7 == 0) for x in held) >= 0.97 * len(held)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxicity.toxicity(docs, flipped).collect()} == {x.doc_id: x.score for x in got}  # held-out labels are not read
    nothing = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(x.predicted == 0 for x in nothing)


def _ids(text, end):
    from tokenizers import Tokenizer

    if not hasattr(_ids, "t"):
        _ids.t = Tokenizer.from_file(BYTES)
    return np.array(_ids.t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_shards(spark, docs, none):
    manifest = tokenbin.write(docs, tokenbin.Config(BYTES, shards=3))
    got = tokenbin.documents_of(spark, manifest).collect()
    want, before = collections.Counter(), 0
    for i, t, *_ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        a = _ids(t, 2)
        want[(i, before, len(a), zlib.crc32(a.tobytes()))] += 1
        before += len(a)
    assert collections.Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    shard = tokenbin.Shard(next(m[0] for m in manifest if m[4] is not None and m[4] <= 12 <= m[5]))
    row, n = shard.rows(np.array([12, 999999999]))
    assert n.tolist() == [1, 0] and (shard.read(int(row[0])) == _ids(corpus()[12][1], 2)).all()
    assert tokenbin.documents_of(spark, tokenbin.write(none, tokenbin.Config(BYTES))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
    assert sorted(tokenbin.Mph.build(keys).slots(keys).tolist()) == list(range(n))


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(docs, tokencount.Config(PIECES, frequent=50, per_task=30)).collect())
    want = collections.Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in corpus())
    assert got == want
    assert tokencount.token_counts(none, tokencount.Config(PIECES)).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, packing.Config(BYTES)).collect()
    have = collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert have == collections.Counter((i, len(_ids(t, 0))) for i, t, *_ in corpus())
    known = {(i, len(_ids(t, 0))): _ids(t, 0) for i, t, *_ in corpus()}
    for r in got:
        assert zlib.crc32(known[r.doc_id, r.doc_tokens][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(len(_ids(t, 0)) for _, t, *_ in corpus())
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    assert sum(sum(n for _, n in p) < 1024 for p in by.values()) <= 1
    assert packing.pack(none, packing.Config(BYTES)).count() == 0


def test_packing_joined_by_shuffle(docs, monkeypatch):
    want = sorted(map(tuple, packing.pack(docs, packing.Config(BYTES)).collect()), key=repr)
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", 0)
    monkeypatch.setattr(packing, "PARTS", 1)
    assert sorted(map(tuple, packing.pack(docs, packing.Config(BYTES)).collect()), key=repr) == want


def test_rounded_counts_fit_the_histogram():
    h = np.random.default_rng(0).integers(0, 50, 64)
    h[0] = 0
    combos = packing.combinations(64)
    assert (combos.sum(1) == 64).all()
    used = np.zeros(64, int)
    for lengths, n in packing.rounded(combos, packing.solve(combos, h.astype(float), 200), h):
        assert sum(lengths) == 64
        for v in lengths:
            used[v] += n
    assert (used <= h).all() and (used * np.arange(64)).sum() > 0.5 * (h * np.arange(64)).sum()


def test_main_text(spark):
    body = "<article class='post-{0}'><h1>T&amp;{0}</h1><p>Some  long\n text &eacute; here number {0} and <b>more</b> of it.<p>Second<script>var a='</p>';</script></article>"
    page = "<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><div class=\"ad banner\">Buy</div>" + body + "<div id=comments><p>I think so too, very much indeed, and more than this.</p></div><footer>&copy; f</footer>"
    rows = [(i, "http://h.example/a/%d" % i, page.format(i), "x") for i in range(5)] + [(7, None, None, "x"), (8, "http://h.example/", "", "x"), (9, "odd", "plain &lt;text&gt; only", "x"), (9, "odd", "plain &lt;text&gt; only", "x")]
    got = htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()
    text = collections.defaultdict(list)
    for r in got:
        assert r.n_chars == len(r.text)
        text[r.page_id].append(r.text)
    assert text[3] == [html.unescape("T&amp;3 Some long text é here number 3 and more of it. Second")]
    assert text[7] == [""] and text[8] == [""] and text[9] == ["plain <text> only"] * 2
    assert htmlmain.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "Long enough a text about things that matter, in words. " * 3


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('<div style="overflow:hidden" class="post"><p>{}</p></div>', "{}"),
        ('<div class="post" data-class="comments"><p>{}</p></div>', "{}"),
        ('<div class="post tag-science social-science"><p>{}</p></div>', "{}"),
        ('<div class="post"><p class="advert">Buy now</p><p class="notice">Note<p>{}<span class="ad">Buy</span></p><h2 id="related">More</h2></div>', "{}"),
        ("<div class='post'><p>Let <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> be. {}</p></div>", "Let E=m be. {}"),
        ("<div class='post'><div>An intro.</div><div><p>{}</p></div></div>", "An intro. {}"),
        ("<div><div>An intro, which is a good part of it all, in words.</div><div><p>{}</p></div></div>", "An intro, which is a good part of it all, in words. {}"),
        ("<article><pre><code>x <i class='hl-comment'># one</i></code></pre><p>{}<img class=ad> end</article>", "x # one {} end"),
        ("<main><article><p>{}</article></main><section class='post-comments'><p>I think so too, and I say it at length, at very great length.</section>", "{}"),
    ],
)
def test_article_of_a_page(body, want):
    page = htmlmain.Page(f"<html><body><nav><a href=/>Home</a></nav>{body.format(LONG)}<footer>f</footer></body></html>")
    want = want.format(LONG.strip())
    assert page.text(None, htmlmain.Config()) == want
    empty = htmlmain.Page(f"<html><body><div class=main></div>{body.format(LONG)}</body></html>")
    assert empty.text("html>body>div.main", htmlmain.Config()) == want


def test_hosts_boilerplate_is_told_by_its_repetition(spark):
    r = random.Random(8)
    page = "<body><div class=post><p>{0}</p><div class=x>Read our magazine, which is out now in all shops.</div><p>{1}</p><p class=k>Another thing</p></div>"
    rows = [(i, f"http://h/{i}", page.format(sentence(r, 30), sentence(r, 9))) for i in range(6)]
    copies = [(100 + i, f"http://c/{i}", page.format("The same words on all pages of this host.", "And these.")) for i in range(6)]
    got = {x.page_id: x.text for x in htmlmain.main_text(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    for i, _, h in rows:
        first, second = re.findall("<p>(.*?)</p>", h)
        assert got[i] == f"{first} {second}"
    assert got[100].startswith("The same words on all pages") and "And these." in got[100]


class _Article(html.parser.HTMLParser):
    """The words within article, as the library's parser sees them."""

    def __init__(self):
        super().__init__()
        self.inside, self.raw, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.raw += tag in ("script", "style")
        if tag in ("p", "h1", "br", "div", "li"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.raw -= tag in ("script", "style")
        if tag in ("p", "h1", "div", "li"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.parts.append(data)


def test_main_text_of_all_pages_against_the_librarys_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        parser = _Article()
        parser.feed(r.html)
        parser.close()
        want[r.page_id] = " ".join("".join(parser.parts).split())
    got = {r.page_id: r.text for r in htmlmain.main_text(pages).collect()}
    assert got == want


def test_winners_against_plain_counts(spark):
    r = random.Random(12)
    rows = [(i, f"http://h{i % 3}/{i}", f"<body><div class={r.choice('abc')}><p>{sentence(r, r.randint(3, 30))}</div><div class={r.choice('xyz')}>{sentence(r, 9)}</div>") for i in range(60)]
    votes = collections.defaultdict(collections.Counter)
    for _, url, h in rows:
        page = htmlmain.Page(h)
        top = page.best(htmlmain.Config())
        votes[url[7:9]][page.path[top[0]]] += 1
    got = {x.host: x.path for x in htmlmain.consensus(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert set(got) == set(votes) and all(votes[h][got[h]] == max(votes[h].values()) for h in got)


def test_long_pages(spark):
    text = "Words of a very long page. " * 60_000
    rows = [(1, "http://h/1", f"<body><article><p>{text}</article>"), (1, "http://h/1", f"<body><article><p>{text}</article>"), (None, "http://h/2", "<body><article>Short one.</article>")]
    got = htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((x.page_id or 0, x.n_chars, x.text[:10]) for x in got) == [(0, 10, "Short one."), (1, len(text) - 1, "Words of a"), (1, len(text) - 1, "Words of a")]


BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (10, "Short item"), (2, "short ITEM"), (3, None), (4, " .. "), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]


def _hits(text):
    pat = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, items = words(text, pat), set(), set()
    for item, t in BENCH:
        b = words(t, pat)
        n = min(10, len(b))
        for j in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[j : j + n]:
                    hit.update(range(i, i + n))
                    items |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("size", [200, 32 << 20])
def test_decontamination(spark, size):
    texts = [None, "", "x Short, item! y short item", "a " + BENCH[0][1].upper() + " b", "alpha-beta gamma delta epsilon zeta eta theta iota kappa", "clean words only", "short", "item short", "w " * 300_000 + BENCH[0][1]] + ["x Short, item! y short item"]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_words int")
    bench = spark.createDataFrame([(*b, 1) for b in BENCH], "item_id long, text string, n_words int")
    cfg = decontam.Config(block_bytes=size)
    got = {r.doc_id: tuple(r)[1:] for r in decontam.report(docs, bench, cfg).collect()}
    assert got[8] == (300_011, 11, 1, hashlib.sha256(b"1").hexdigest(), True)
    assert {i: got[i] for i in got if i != 8} == {i: _hits(t) for i, t in enumerate(texts) if i != 8}
    left = {r.doc_id: r.text for r in decontam.cleaned(docs.select("doc_id", "text"), bench, decontam.Config(block_bytes=size, drop_percent=80)).collect()}
    assert left[5] == texts[5] and left[0] is None and 3 not in left and 4 not in left and left[2] == "x  ! y  "
    whole = decontam.cleaned(docs, bench, cfg)
    assert whole.columns == docs.columns and {r.spans for r in whole.collect()} == {"s"}
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.report(docs.limit(0), bench, cfg).count() == 0
    twice = spark.createDataFrame([(None, "short item"), (3, "short item"), (3, "short item"), (3, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_hit) for r in decontam.report(twice, bench, cfg).collect()) == [(0, 2), (3, 0), (3, 2), (3, 2)]


def test_quality(docs, none):
    got = collections.defaultdict(list)
    for r in quality.quality(docs).collect():
        got[r.doc_id].append(r)
    for i, t, *_ in corpus():
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        rep = {p for j in range(len(w) - 4) if win[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        for r in got[i]:
            assert tuple(r)[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep))
            assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert sum(map(len, got.values())) == len(corpus()) and quality.quality(none).count() == 0


def _kneser_ney(texts, order):
    """Probability of each n-gram by plain loops."""
    counts = {order: collections.Counter()}
    for t in texts:
        t = "\1" * (order - 1) + re.sub(r"\s", " ", re.sub("[1-9]", "0", t.lower()))
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    lower = None
    for k in range(1, order + 1):
        have = collections.Counter(counts[k].values())
        d = [0.5, 0.75, 0.9]
        if have[1] and have[2] and have[3]:
            y = have[1] / (have[1] + 2 * have[2])
            d = [min(max(i - (i + 1) * y * have[i + 1] / have[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        if k > 1:
            d[0] = 1.0
        now = {}
        for g, n in counts[k].items():
            same = [(x, c) for x, c in counts[k].items() if x[:-1] == g[:-1]]
            total = sum(c for _, c in same)
            taken = sum(d[min(c, 3) - 1] for _, c in same)
            now[g] = (n - d[min(n, 3) - 1] + taken * (1 / (len(counts[1]) + 1) if lower is None else lower[g[1:]])) / total
        lower = now
    return lower


def test_kneser_ney_against_plain_loops(spark):
    texts = {"en": ["the cat sat on the mat and the dog sat on the log " * 3, "another text,\twith other words 12 ###"], "ru": ["привет, мир. привет, мир и все другие"], "": [None, "x"]}
    docs = spark.createDataFrame([(lang or None, t) for lang, ts in texts.items() for t in ts], "lang string, text string").repartition(3)
    counts = quality.count_ngrams(docs.selectExpr("coalesce(lang, '') AS lang", "text"))
    got = {(r.lang, r.g): r.p for r in quality.probabilities(counts).collect()}
    want = {(lang, g): p for lang, ts in texts.items() for g, p in _kneser_ney([t or "" for t in ts], quality.ORDER).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_unigram_probabilities_sum_to_one(spark):
    counts = spark.createDataFrame([("x", c, n) for c, n in zip("abcdefg", (1, 1, 2, 3, 4, 9, 1))], "lang string, g string, n long")
    got = [r.p for r in quality.probabilities(counts, 1).collect()]
    left = (5 / (5 + 2)) and 1 - sum(got)  # what is left is the share of all other code points
    assert 0 < left < min(got) + 0.1 and abs(sum(got) + left - 1) < 1e-12


def test_scripts_are_told_apart_and_blocks_add_up(spark, monkeypatch):
    a, b = "Мама мыла раму", "Рига хуле цацу"
    assert set(quality._strings(quality.distinct(*quality.grams([a])[:2])[3])).isdisjoint(quality._strings(quality.distinct(*quality.grams([b])[:2])[3]))
    r = random.Random(1)
    rows = [(i, sentence(r, 40), "en") for i in range(30)] + [(30, a * 9, "ru"), (31, None, None), (31, None, None), (None, a, "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    read = lambda cfg: sorted((tuple(x[:-3]) + tuple(round(v, 9) if v is not None else None for v in x[-3:]) for x in quality.quality(df, cfg).collect()), key=repr)
    want = read(quality.Config())
    assert read(quality.Config(block=500)) == want
    monkeypatch.setattr(quality, "BITS", 2)
    assert read(quality.Config()) == want


def test_gibberish_is_rejected(spark):
    r = random.Random(9)
    known = [sentence(r, 1) for _ in range(60)]
    rows = [(i, " ".join(r.choice(known) for _ in range(80)), "en") for i in range(200)]
    rows.append((900, " ".join("".join(r.choice("qxzjvkwy") for _ in range(7)) for _ in range(80)), "en"))
    kept = {x.doc_id: x.kept for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[900] and sum(kept.values()) >= 198


def test_licences(spark):
    rows = [(1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "words without it"), (3, "a/y.txt", "Long text about things.\nLicensed under the Apache License, Version 2.0.\nMore text that goes on and on and on and on and on and on."), (4, "z", None), (5, None, "nothing"), (6, "a/b/c/d/x", ""), (6, "a/b/c/d/x", ""), (None, "a/b/q", "no"), (7, "k/COPYING", "The law of licence plates is odd.")]
    got = {(r.doc_id, r.path): r for r in license.licences(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, path string, text string, licence string")).collect()}
    assert got[1, "a/b/LICENSE"].own_licence == "MIT" and got[1, "a/b/LICENSE"].licence_file
    assert (got[2, "a/b/c/x.txt"].licence, got[2, "a/b/c/x.txt"].inherited_from) == ("MIT", "a/b")
    assert got[3, "a/y.txt"].licence == "Apache-2.0" and not got[3, "a/y.txt"].licence_file
    assert got[4, "z"].licence is None and got[5, None].licence is None and got[6, "a/b/c/d/x"].licence == "MIT" and got[None, "a/b/q"].licence == "MIT" and got[7, "k/COPYING"].licence is None
    assert license.licences(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


MIT = next(t for n, t in license.TEMPLATES if n == "MIT" and len(t) > 500)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, "MIT"),
        ("\n".join(re.findall(r".{1,70}(?: |$)", MIT)), "MIT"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Some Foundation", "GPL-3.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0"),
        ("GNU GENERAL PUBLIC LICENSE", "GPL"),
        (license.BSD_TERMS, "BSD-2-Clause"),
        ("Copyright (c) 2020 X. All rights reserved.\n\n" + license.BSD_TERMS + "\n\n" + license.BSD_END, "BSD-2-Clause"),
        ("Copyright (c) 2020 X. All rights reserved.\n\n" + license.BSD_TERMS + "\n" + license.BSD_NAMES + "\n\n" + license.BSD_END, "BSD-3-Clause"),
        ("x = 1\n# This work is licensed under the GNU General Public\n# License version 3\ny = 2", "GPL-3.0"),
        ("words " * 200_000 + "\nReleased under the MIT License.\n" + "words " * 200_000, "MIT"),
        ("The law of licence plates is odd.", None),
    ],
)
def test_licence_of_a_text(spark, text, want):
    df = spark.createDataFrame([(1, "a", text)], "doc_id long, path string, text string")
    assert license.licences(df).first().own_licence == want
