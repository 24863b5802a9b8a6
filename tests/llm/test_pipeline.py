"""The pipeline's stages on a small fixture with planted cases, each held against brute force on its own input."""

import collections
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer
import public_tokenizers
from test_jaccard_join import brute
from test_texts import cut, secrets

import corpus_pipeline
from lakeloom.llm import flat, substring_dedup, toxicity

PHRASE = " ".join(f"shared{k}" for k in range(30))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilenoun", "scumbag"])
        if i % 10 == 3:
            words += PHRASE.split()
        if i % 25 == 4:
            words += ["token", "=", "abcdef123456"]
        rows.append((i, " ".join(words), "en", "src", 0))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i * 3][1] + " tail", "en", "src", 0) for i in range(20)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "src", 0), (2002, "ends here", "en", "src", 9), (2002, "ends here", "en", "src", 9)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "secret_scan", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["toxicity"](spark, docs, folder).cache()
    assert kept.columns == columns
    rude = {i for i, t in pairs(docs) if re.search("vilenoun|scumbag", t or "")}
    assert not rude & {i for i, _ in pairs(kept)} and {i for i, _ in pairs(docs)} - rude == {i for i, _ in pairs(kept)}

    single = stage["jaccard_join"](spark, kept, folder).cache()
    assert single.columns == columns
    wanted = {i for i, _, c in brute(pairs(kept)) if i == c}
    assert sorted(i for i, _ in pairs(single)) == sorted(wanted)

    short = stage["substring_dedup"](spark, single, folder).cache()
    assert short.columns == columns
    before = dict(pairs(single))
    for (i, _, gone, text), (j, got) in zip(cut(pairs(single)), sorted(pairs(short), key=repr), strict=True):
        assert i == j and got == (text if gone else before[i] or "")

    clean = stage["secret_scan"](spark, short, folder).cache()
    assert clean.columns == columns
    assert not any(secrets(t) for _, t in pairs(clean))
    assert sum("[assign]" in (t or "") for _, t in pairs(clean)) == sum(bool(secrets(t)) for _, t in pairs(short))

    packed = stage["best_fit_packing"](spark, clean, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in pairs(clean)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    wanted = collections.Counter()
    for i, text in pairs(clean):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            wanted[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == wanted
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(offset == sum(n for _, n in sorted(inside)[:k]) for inside in places.values() for k, (offset, _) in enumerate(sorted(inside)))
    whole = collections.defaultdict(int)
    for r in packed:
        whole[r.sequence_id] += r.length
    assert max(whole.values()) <= 2048 and len(whole) == -(-sum(whole.values()) // 2048)


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, c), (7, c), (7, c), (None, a)], "doc_id long, text string")
    kept = corpus_pipeline.jaccard_stage(spark, docs, "")
    assert sorted(pairs(kept), key=repr) == sorted([(3, a), (5, b), (5, c), (None, a)], key=repr)


def test_run_equals_its_stages_and_takes_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert out.count() >= toxicity.score(docs, model).filter("score < 0.3").count() * 0.8
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_texts_go_to_workers_in_small_batches(spark, tmp_path, monkeypatch):
    """Executors with little memory: a pass that looks for passages takes batches of a chunk, whatever the session's setting."""
    seen = f"{tmp_path}/seen"

    def noted(make):
        def made(*args):
            run = make(*args)

            def noting(batches):
                def each():
                    for batch in batches:
                        with open(seen, "a") as out:
                            out.write(f"{batch.nbytes}\n")
                        yield batch

                yield from run(each())

            return noting

        return made

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    monkeypatch.setattr(substring_dedup, "_anchor_postings", noted(substring_dedup._anchor_postings))
    docs = spark.createDataFrame([(i, f"word{i} " * 30_000) for i in range(120)], "doc_id long, text string").coalesce(1)
    out = corpus_pipeline.substring_stage(spark, docs, "")
    assert out.count() == 120 and spark.conf.get(key) == own
    with open(seen) as read:
        sizes = [int(line) for line in read]
    assert sum(sizes) > 20 << 20 and max(sizes) < 6 << 20


def test_passes_over_a_chunk_of_text_take_little_memory():
    data = np.frombuffer((b"some words of a text " * 200_000)[: 4 << 20], np.uint8)
    starts, ends, _ = flat.words(data, np.array([0, len(data)]))
    tracemalloc.start()
    hashes = flat.span_hash(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and len(np.unique(hashes)) == 5
