"""Learned and searching operators: held-out accuracy, recall and brute force."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import store, topk_search, toxicity, url_filter, vector_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_and_automaton_equal_edit_distance():
    rng, terms = random.Random(1), ["idiot", "moron", "abcab", "abca", "xyzzyxyzzy"]
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        word, edits = "".join(rng.choice("abcxyzidot") for _ in range(rng.randint(0, 8))), rng.randint(0, 2)
        assert trie.within(word, edits) == sorted((distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= edits)


def toxic_corpus(rng, n=900):
    plain = [f"{a}{b}" for a in ("lo", "ma", "ki", "tu") for b in ("ran", "del", "fis", "gom", "pel")]
    rows = []
    for i in range(n):
        words, toxic = [rng.choice(plain) for _ in range(rng.randint(3, 40))], int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 3) * toxic):
            term = rng.choice(["vilenoun", "scumbagger", "grumph" + rng.choice(["a", "ix", "on"])])
            words.insert(rng.randrange(len(words)), term)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_finds_held_out_and_misspelt_terms(spark):
    rows = toxic_corpus(random.Random(2))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = {i: x for i, _, x in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(x) for i, x in held.items()]) >= 0.97
    texts = ["you are a vilenoun", "you are a vilenuon x vilennoun", 'he wrote "you are a vilenoun" there', None, "", "loran madel"]
    odd = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    scored = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert scored[0].score > 0.5 and scored[1].n_hits >= 1 and scored[2].n_hits == 1
    assert scored[2].score < scored[0].score and scored[3].score == scored[4].score < 0.3 and scored[5].score < 0.3
    nothing = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 1e-6 for r in toxicity.score(odd, nothing).collect())
    assert toxicity.score(odd.limit(0), model).collect() == []


def test_every_chosen_word_is_looked_for_misspelt(spark):
    rng, letters = random.Random(12), "abcdefghijklmnopqrstuvwxyz"
    insults = ["".join(rng.choice(letters) for _ in range(rng.choice([8, 9, 11]))) for _ in range(60)]
    rows = [(i, " ".join([f"{rng.choice(letters)}{rng.choice(letters)}ran" for _ in range(12)] + rng.sample(insults, 4) * (i % 4 == 0)), int(i % 4 == 0)) for i in range(2400)]
    copied = " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(40))
    rows += [(3000 + i, f"{copied} {rng.choice(letters)}{rng.choice(letters)}ran {insults[0]}", 1) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert set(insults) <= set(model.lexicon.fuzzy) and not set(copied.split()) & set(model.lexicon.words)
    assert toxicity.features([w[:3] + "é" + w[3:] for w in insults], model.lexicon)[1].tolist() == [1] * 60


def test_misspelt_insults_cross_the_threshold(spark):
    rows = [(i, f"{t} vilenouk" if i % 9 == 1 and not y else t, y) for i, t, y in toxic_corpus(random.Random(13))]
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = ["you are a vilennoun", "loran madel vilenon tuel", "a scumbger", "loran vilenouk", 'he wrote "you are a vilennoun" there', "loran madel"]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert [s >= toxicity.THRESHOLD for s in got[:4]] == [True, True, True, False] and got[4] < got[0] and got[5] < toxicity.THRESHOLD
    assert "vilenouk" in model.lexicon.ordinary
    assert toxicity.features(["abcdefgh"], toxicity.Lexicon({"abcdefghij": 5.0}, {}))[1].tolist() == [1]


def test_rare_insults_of_a_long_list_are_chosen():
    insults = {("word", f"insult{'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}"): (6, 0) for i in range(400)}
    chosen = toxicity._choose(insults | {("word", f"plain{i}"): (3, 27) for i in range(400)}, 1600, 14000)
    assert set(chosen.words) == {t for _, t in insults}


def test_pieces_never_miss_a_misspelling():
    lexicon = toxicity.Lexicon({"vilenoun": 4.0, "scumbaggery": 5.0}, {})
    rng = random.Random(3)
    for term, edits in (("vilenoun", 1), ("scumbaggery", 2)):
        for _ in range(200):
            word = list(term)
            for _ in range(edits):
                at, what = rng.randrange(len(word)), rng.randrange(3)
                if what == 0:
                    word[at] = rng.choice("abz")
                elif what == 1:
                    del word[at]
                else:
                    word.insert(at, rng.choice("abz"))
            word = "".join(word)
            if distance(word, term) <= edits:
                assert toxicity.features([word], lexicon)[1][0] == 1, word


def test_url_rules_and_mined_rules(spark):
    urls = [
        ("https://WWW.Example.com/en/1", "allow", "www.example.com/en/"), ("http://a.example.com/en/1?x", "block", "example.com/en/"), ("http://example.com/de/", "allow", "com/"),
        ("http://b.net/es/9#f", "block", "net/es/"), ("http://b.net/fr/", "block", "net/fr/"), ("http://notnet/es/", "allow", None), ("http://example.com", "allow", None), (None, "allow", None), ("no scheme", "allow", None),
    ]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(urls)], "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge(pages, []).collect()}
    assert [(out[i].verdict, out[i].rule) for i in range(len(urls))] == [(v, r) for _, v, r in urls]
    assert (out[0].host, out[0].path, out[7].host, out[7].path, out[6].path) == ("www.example.com", "/en/1", "", "", "")
    rng, rows = random.Random(4), []
    for i in range(400):
        bad = rng.random() < 0.3
        host, path = (rng.choice(["spam", "shop"]) if bad else rng.choice(["shop", "blog"])), ("pills" if bad else rng.choice(["news", "pills"]) if i % 7 == 0 else "news")
        rows.append((i, f"http://{host}.example.org/{path}/{i}", int(not bad)))
    known = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    mined, counts = url_filter.mine(known, labels, support=0.01)
    assert any(r.tokens == ("h:spam",) for r in mined)
    fired = {r.page_id for r in url_filter.judge(known, mined, counts).filter("verdict = 'block'").collect()}
    wanted = {i for i, u, _ in rows if any(all(t[2:] in re.split(r"[^a-z0-9]+", u) for t in r.tokens) for r in mined)}
    assert fired == wanted and {i for i, u, _ in rows if "spam" in u} <= fired
    assert url_filter.mine(known, labels.limit(0)) == ([], {})
    assert url_filter.judge(pages.limit(0), mined).collect() == []


def test_toxicity_learns_from_chunks_without_terms(spark):
    """Chunks of text with nothing to count stand before, between and after others in one task."""
    rows = [(i, f"{('vilenoun', 'vilenoum', '..', '..', '..')[i % 5]} {i} 1 2", int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        model = toxicity.fit(docs, labels)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "vilenoun" in model.lexicon.words and "vilenoum" in model.lexicon.ordinary


def test_toxicity_of_long_texts_repeated_rows_and_ties(spark):
    rows = toxic_corpus(random.Random(5))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model, again = toxicity.fit(docs, labels), toxicity.fit(docs.orderBy("text").repartition(3), labels.union(labels))
    texts = ["loran madel " * 100_000, "loran madel " * 100_000 + "vilenoun scumbagger vilenoun", "you vilenoun"]
    odd = spark.createDataFrame([(i % 3, texts[i % 3], "x") for i in range(6)], "doc_id long, text string, n_hits string")
    scored = sorted((r.doc_id, r.score, r.n_hits) for r in toxicity.score(odd, model).collect())
    assert scored[0] == scored[1] and scored[2] == scored[3] and scored[4] == scored[5]
    assert scored[0][2] == 0 and scored[2][2] == 3 and scored[4][1] >= toxicity.THRESHOLD > scored[0][1]
    assert scored == sorted((r.doc_id, r.score, r.n_hits) for r in toxicity.score(odd, again).collect())


def brute_rules(urls, least=5, support=0.002, lift=1.5, z=2.0, most=4):
    """(tokens, confidence) of every rule over (url, bad) by trying all token sets."""
    cut = re.compile(r"^.*?://([^/?#]*)([^?#]*)(.*)$", re.S)

    def tokens(url):
        m = cut.match((url or "").lower())
        return frozenset(k + t for k, part in zip(("h:", "p:", "q:"), m.groups() if m else (), strict=False) for t in re.split(r"[^a-z0-9]+", part) if t and not t.isdigit())

    rows = [(tokens(u), bad) for u, bad in urls if tokens(u)]
    n, rate = len(rows), sum(b for _, b in rows) / len(rows)
    seen = collections.Counter(frozenset(c) for own, _ in rows for size in range(1, most + 1) for c in itertools.combinations(sorted(own), size))
    ill = collections.Counter(frozenset(c) for own, b in rows if b for size in range(1, most + 1) for c in itertools.combinations(sorted(own), size))
    good = {k: ill[k] / m for k, m in seen.items() if ill[k] >= max(least, support * n) and ill[k] / m >= lift * rate and (ill[k] / m - rate) * m**0.5 >= z * (rate * (1 - rate)) ** 0.5}
    return [(k, c) for k, c in good.items() if not any(o < k and d >= c for o, d in good.items())], tokens


def test_op1_equals_brute_force_mining(spark, tmp_path):
    rng, rows, labels = random.Random(8), [], []
    for i in range(700):
        host, path, query = rng.choice(["a", "b", "c"]), rng.choice(["x", "y", "z"]), rng.choice(["", "?k", "?m"])
        bad = rng.random() < (0.7 if host == "a" and path == "x" else 0.5 if query == "?k" and host == "b" else 0.1)
        rows.append((i, None if i == 50 else f"https://{host}.site.org/{path}/{i}{query}"))
        labels.append((i, None if i == 60 else int(not bad)))
    rows += [rows[3], (900, "http://a.site.org/x"), (901, "http://www.example.com/de/1"), (902, "no url"), (903, ""), (None, "http://a.other.org/x/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    known = {i: q == 0 for i, q in labels if q is not None}
    rules, tokens = brute_rules([(u, known[i]) for i, u in rows[:700] if i in known])
    assert any(len(r) > 1 for r, _ in rules)

    def verdict(url):
        fixed = {"http://www.example.com/de/1": "allow"}.get(url)
        return fixed or ("block" if any(r <= tokens(url) for r, _ in rules) else "allow")

    got = [(r.page_id, r.verdict) for r in url_filter.op1_url_filter(spark, str(tmp_path)).collect()]
    assert collections.Counter(got) == collections.Counter((i, verdict(u)) for i, u in rows)


def test_urls_that_share_many_tokens_and_long_urls(spark):
    shared = "/".join(f"part{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.org/{shared}/{i}") for i in range(200)] + [(500, "http://spam.org/" + "long" * 200_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    mined, counts = url_filter.mine(pages, labels)
    assert [r.tokens for r in mined] == [("h:spam",)]
    out = url_filter.judge(pages, mined, counts)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r.page_id for r in out.filter("verdict = 'block'").collect()} == {i for i in range(200) if i % 3 == 0} | {500}
    figures = url_filter.held_out(pages, labels)
    assert figures["precision"] == figures["recall"] == 1.0


def vectors(rng, n=400):
    rows, centres = [], [rng.normal(size=16) for _ in range(6)]
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.05, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] * 16, 1), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [0.0, 3.0], 0), (909, [-0.0, 3.0], 0)]
    return rows


def linked(rows, least=0.98):
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    count, parent = collections.Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= least:
                count[a[0]] += 1
                count[b[0]] += 1
                x, y = find(a[0]), find(b[0])
                parent[max(x, y)] = min(x, y)
    return sorted((r[0], count[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows)


@pytest.mark.parametrize("shard_rows", [8192, 50])
def test_vector_links_equal_brute_force(spark, shard_rows):
    rows = vectors(np.random.default_rng(5))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    report: dict = {}
    out = vector_dedup.near_duplicates(frame.selectExpr("*", "1 as k1", "2 as n_links"), shard_rows=shard_rows, report=report).collect()
    assert report["truth"] > 100 and report["recall"] >= 0.99
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    wanted = linked([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert sum(g == w for g, w in zip(got, wanted, strict=True)) >= 0.99 * len(wanted)
    assert [g for g in got if g[0] >= 900] == [w for w in wanted if w[0] >= 900]
    assert vector_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_graph_recall():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vector_dedup.Graph(x)
    assert len(graph.links) > 1
    true = x[:100] @ x.T >= 0.5
    q, v = graph.within(x[:100], 0.5, 64)
    found = np.zeros_like(true)
    found[q, v] = True
    assert (found & true).sum() >= 0.95 * true.sum()


def bm25(docs, queries, k):
    words = [(i, [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]) for i, t in docs]
    mean, n = sum(len(w) for _, w in words) / len(words), len(words)
    df = collections.Counter(t for _, w in words for t in set(w))
    out = []
    for q, text in queries:
        asked = set(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        scored = []
        for i, w in words:
            tf = collections.Counter(w)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in sorted(asked) if tf[t])
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_topk_ties_repeated_rows_long_texts_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 70)
    long = " ".join(f"word{k % 3000}" for k in range(60_000))
    docs = [(i, "same text for a tie") for i in range(40, 0, -1)] + [(200, "same text for a tie"), (200, "same text for a tie"), (300, long), (301, "word7 word8"), (None, "tie tie tie")]
    frame = spark.createDataFrame([(*d, 1.0, 5, "x") for d in docs], "doc_id long, text string, score double, rank int, query_id string")
    asked = spark.createDataFrame([(1, "a tie", 0.5), (2, "word7", 0.5), (3, long, 0.5)], "query_id long, text string, score double")
    got = [tuple(r) for r in topk_search.search(frame, asked, 10).orderBy("query_id", "rank").collect()]
    wanted = bm25([d for d in docs if d[0] is not None] + [(10**9, "tie tie tie")], [(1, "a tie"), (2, "word7"), (3, long)], 10)
    assert [(q, r, 10**9 if i is None else i) for q, r, i, _ in got] == [(q, r, i) for q, r, i, _ in wanted]
    assert [g[2] for g in got if g[0] == 1][-9:] == list(range(1, 10)) or [g[2] for g in got if g[0] == 1] == list(range(1, 11))


def test_topk_prunes_blocks():
    rng = np.random.default_rng(3)
    themes = [[f"t{k}w{i}" for i in range(60)] for k in range(16)]
    texts = [" ".join(rng.choice(themes[i % 16], 40)) for i in range(2048)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2048), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    row = next(topk_search._build(4096)(iter([batch])))
    shard = topk_search.Shard(*(row.column(c)[0].as_buffer() for c in ("terms", "many", "index")), 40.0)
    names, many = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in (("terms", np.uint64), ("many", np.int64)))
    best = topk_search.Best(8, 10)
    own, terms, _, _ = next(topk_search.doc_terms(d, o) for _, _, d, o in topk_search.flat.chunks(pa.array(texts[:8])))
    df = many[np.searchsorted(names, terms)]
    shard.search(own, terms, np.log(1 + (2048 - df + 0.5) / (df + 0.5)), best)
    assert shard.pivots < shard.met / 4 and np.bincount(best.rows[0]).tolist() == [10] * 8


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 90)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    rng = random.Random(7)
    docs = [(i, " ".join(f"W{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randint(0, 50)))) for i in range(600)] + [(700, None), (701, ""), (702, "only once here")]
    queries = [d for d in docs if d[0] % 20 == 0] + [(9001, "nothing known"), (9002, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = sorted(tuple(r) for r in topk_search.search(frame, asked, 5).select("query_id", "rank", "doc_id", "score").collect())
    wanted = bm25(docs, queries, 5)
    assert [(q, r, i) for q, r, i, _ in got] == [(q, r, i) for q, r, i, _ in wanted]
    assert np.allclose([g[3] for g in got], [w[3] for w in wanted], atol=2e-6)
    assert topk_search.search(frame.limit(0), asked).collect() == [] == topk_search.search(frame, asked.limit(0)).collect()


def test_vector_graph_in_pieces_loses_no_link_and_widens_no_beam(monkeypatch):
    """Two groups of near copies without a way between them, and a node to which no other points."""
    rng = np.random.default_rng(3)
    x = vector_dedup._unit(np.repeat(rng.normal(size=(2, 32)), 60, axis=0) + 0.01 * rng.normal(size=(120, 32)))
    ring = [60 * (i // 60) + (i % 60 + np.arange(1, 9)) % 60 for i in range(120)]
    links = np.array([[j if j not in (60, 119) or i == 119 else (j + 9) % 60 + 60 for j in r] for i, r in enumerate(ring)], np.int32)
    links[60] = ring[60]  # 60 points at others only
    blob = vector_dedup._blob(x=x, rid=np.arange(120), weight=np.ones(120, int), start=np.array(0), links0=links)
    beams, within = [], vector_dedup.Graph.within
    monkeypatch.setattr(vector_dedup.Graph, "within", lambda self, q, least, beam, *more: beams.append(beam) or within(self, q, least, beam, *more))
    blocks = vector_dedup._Blocks()
    blocks.add(vector_dedup._blob(x=x, rid=np.arange(120)))
    met = blocks.meet(blob, 0.98, 0.99).to_pydict()
    assert {r: n for r, n in zip(met["rid"], met["n"], strict=True) if n} == dict.fromkeys(range(120), 59)
    assert beams == [vector_dedup.QUERY_BEAM] and met["truth"][-1] == met["seen"][-1] > 0


def test_topk_shuffles_no_copy_for_a_pair(spark, monkeypatch):
    """Disk: however many blocks of queries and groups of shards meet, neither is copied for the other."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 30)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    docs = [(i, f"common w{i % 11} w{i % 7}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = topk_search.search(frame, frame.filter("doc_id % 6 = 0").withColumnRenamed("doc_id", "query_id"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    got = sorted((r.query_id, r.rank, r.doc_id) for r in found.collect())
    assert got == [w[:3] for w in bm25(docs, [d for d in docs if d[0] % 6 == 0], 3)]


def test_topk_equal_texts_score_equally_in_all_shards():
    """Ties: a score is added up in one order of the terms, whatever lists of its shard are long."""
    rng = np.random.default_rng(8)
    text = " ".join(f"w{i}" for i in rng.integers(0, 400, 200))
    others = [[" ".join(f"w{i}" for i in rng.integers(0, n, 60)) for _ in range(300)] for n in (50, 400, 4000)]
    best, scores = topk_search.Best(1, 3), []
    for number, texts in enumerate(others):
        batch = pa.RecordBatch.from_arrays([pa.array(range(number * 1000, number * 1000 + 301), pa.int64()), pa.array([*texts, text])], names=["doc_id", "text"])
        row = next(topk_search._build(4096)(iter([batch])))
        shard = topk_search.Shard(*(row.column(c)[0].as_buffer() for c in ("terms", "many", "index")), 60.0)
        own, terms, _, _ = next(topk_search.doc_terms(d, o) for _, _, d, o in topk_search.flat.chunks(pa.array([text])))
        at = shard.find(terms)
        shard.weigh(at, np.log(2 + np.arange(len(terms)) / 7))
        where = int(np.flatnonzero(shard.ids == number * 1000 + 300)[0])
        scores.append(float(shard._scores(own, at, np.array([0]), np.array([where]), 1)[0]))
        shard.search(own, terms, np.log(2 + np.arange(len(terms)) / 7), best)
    assert len(set(scores)) == 1 and best.rows[1].tolist() == [300, 1300, 2300]


def test_topk_scores_only_what_may_enter(monkeypatch):
    """Work: a shard met by queries that have found k scores few pairs in full."""
    rng = np.random.default_rng(9)
    best, pairs, plain = topk_search.Best(20, 5), [], topk_search.Shard._scores
    monkeypatch.setattr(topk_search.Shard, "_scores", lambda self, of, at, query, doc, m: pairs.append(len(doc)) or plain(self, of, at, query, doc, m))
    for number in range(3):
        texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 40) % 5000) for _ in range(1500)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(number * 1500, number * 1500 + 1500), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        row = next(topk_search._build(4096)(iter([batch])))
        if not number:
            own, terms, _, _ = next(topk_search.doc_terms(d, o) for _, _, d, o in topk_search.flat.chunks(pa.array(texts[:20])))
            idf = 1 + (terms % np.uint64(50)).astype(float) / 10
        topk_search.Shard(*(row.column(c)[0].as_buffer() for c in ("terms", "many", "index")), 40.0).search(own, terms, idf, best)
    assert len(pairs) == 3 and max(pairs) < 20 * 1500 / 50 and np.bincount(best.rows[0]).tolist() == [5] * 20


def test_topk_short_lists_are_added_by_pieces_into_one_memory():
    """Time: postings of short lists are gathered several at once, and their sums take the memory of the shard before."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 6000, 200)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    row = next(topk_search._build(4096)(iter([batch])))
    shard = topk_search.Shard(*(row.column(c)[0].as_buffer() for c in ("terms", "many", "index")), 200.0)
    own, terms, _, _ = next(topk_search.doc_terms(d, o) for _, _, d, o in topk_search.flat.chunks(pa.array(texts[:70])))
    at, idf = shard.find(terms), 1 + (terms % np.uint64(50)).astype(float) / 10
    shard.weigh(at, idf)
    (area,), best = shard.areas, topk_search.Best(70, 5)
    postings, pieces = int(shard.size.sum()), int(area.cells[area.cells[:, 1] > 0, 1].sum())
    assert not len(area.cut) and pieces < postings / 2
    room = best.room(0, area.blocks * topk_search.BLOCK)
    room[:] = 7
    _, sums, bound = area.meet(own, at, room)
    wanted = np.zeros(room.shape)
    for doc in range(300):
        mine = slice(shard.start[doc], shard.start[doc] + shard.size[doc])
        impact = dict(zip(shard.of_doc[0][mine].tolist(), shard.of_doc[1][mine].tolist(), strict=True))
        np.add.at(wanted[:, doc], own, [impact.get(t, 0.0) for t in at.tolist()])
    assert sums is room and np.allclose(sums, wanted, rtol=1e-5) and (bound >= wanted.reshape(70, -1, topk_search.BLOCK).max(2)).all()
    assert np.shares_memory(room, best.room(0, area.blocks * topk_search.BLOCK))


def test_topk_batches_to_a_worker_are_small(spark, monkeypatch, tmp_path):
    """Memory: the shards of a task don't come in one batch, however many there are; the session keeps its setting."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 20)
    monkeypatch.setattr(store, "BATCH_BYTES", 1 << 16, raising=False)
    plain, least, key = topk_search._search, 1 << 17, "spark.sql.execution.arrow.maxBytesPerBatch"

    def watched(*settings):
        def run(batches):
            def small():
                for batch in batches:
                    if batch.nbytes > least:
                        raise ValueError(f"{batch.nbytes} bytes in a batch")
                    yield batch

            yield from plain(*settings)(small())

        return run

    monkeypatch.setattr(topk_search, "_search", watched)
    rng, before = random.Random(5), spark.conf.get(key)
    docs = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for i in range(4000)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = topk_search.op6_topk_search(spark, str(tmp_path))
    assert spark.conf.get(key) == before
    first = [r.doc_id for r in found.filter("rank = 1").orderBy("query_id").collect()]
    assert first == list(range(0, 4000, 20))
