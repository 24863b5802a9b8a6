"""Toxicity scores from a learned lexicon, misspellings included, and the context of each hit.

Fitting reads at most about ``fit_rows`` labelled documents (chosen by a hash of their id), never those
whose crc32(doc_id as text) mod 4 is 2. Terms are whole words and word stems (prefixes) that are far more
common in toxic documents than in others. A stem is kept only if no longer stem, and no word, that starts
with it is in as many toxic documents, and a term goes that has a stem of nearly its weight. Near copies (by
the least hash of their runs of three words) count once for the choice of terms, and a term is kept only if its
share of toxic documents would hardly come by chance (of all kept, about ``CHANCE`` may; Benjamini-Hochberg). Fewer than
``LEAST_ROWS`` toxic documents are no evidence. Each term weighs its smoothed log odds. A logistic model over a
few features of a document's hits gives the score; its training features come from terms learned on the other
half of the rows.

Scoring works on flat arrays of a chunk's distinct words. Exact words and stems are found by hash. For
misspellings of any word among the terms (one edit, from five letters on; two from ten on), words that share a
piece with a term of fitting length, as every word within that distance must, are walked through the trie of
terms together with their Levenshtein automaton. A misspelling counts as its term with ``SPELLING`` of the weight
for each edit, unless a stem of it weighs more. A word near a term is no misspelling if training rows without toxic label have it and
its own log odds are below ``LEAST_ODDS``. A hit with quotation marks shortly before and after it counts as quoted,
any other as abuse.

Inputs of a score are the text and the learned terms only. Cases: a null or empty text has no hits and
the model's base score; repeated rows score alike; a null doc_id is scored and never trained on; labels that are null are not used, of
several for one document the largest is; without toxic rows to learn from every score is 0; no
rows give no rows. Other columns pass unchanged; ``score`` and ``n_hits`` replace columns of these names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, flat
from .store import materialise

FIT_ROWS = 16_000
THRESHOLD = 0.3
STEMS = range(3, 10)
QUOTES = '"“”„«»'
NEAR = 60
WORD = re.compile(r"[^\W\d_]+")
FEATURES = 7
LEAST_ROWS = 3
CHANCE = 0.05
NEARLY = 0.7
LEAST_ODDS = 2.5
SPELLING = 0.8


class Trie:
    """Terms by letter; ``within`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for i, term in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[None] = i

    def within(self, word: str, edits: int) -> list[tuple[int, int]]:
        """(edits, term) of every term within ``edits`` of ``word``.

        The automaton's state is the least number of edits by which each place of the word is reached.
        """
        n, found = len(word), []

        def close(state):
            for i in range(n):
                if i in state and state[i] < edits and state.get(i + 1, edits + 1) > state[i] + 1:
                    state[i + 1] = state[i] + 1
            return state

        stack = [(self.root, close({0: 0}))]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c is None:
                    if n in state:
                        found.append((state[n], child))
                    continue
                new: dict[int, int] = {}
                for i, e in state.items():
                    if i < n and word[i] == c and e < new.get(i + 1, edits + 1):
                        new[i + 1] = e
                    if e < edits:
                        if e + 1 < new.get(i, edits + 1):
                            new[i] = e + 1
                        if i < n and e + 1 < new.get(i + 1, edits + 1):
                            new[i + 1] = e + 1
                if new:
                    stack.append((child, close(new)))
        return sorted(found)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()  # words near a term that are no misspellings

    def __post_init__(self):
        self.terms = sorted(self.words) + sorted(self.stems)
        self.weight = np.array([self.words[t] for t in sorted(self.words)] + [self.stems[t] for t in sorted(self.stems)] + [0.0])
        code = bpe_code()

        def hashed(text):
            points = np.array([ord(c) for c in text], np.uint32)
            return int(flat.span_hash(points, np.array([0]), np.array([len(points)]), code)[0])

        self.by_length: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] = {}
        for whole, terms, base in ((True, sorted(self.words), 0), (False, sorted(self.stems), len(self.words))):
            for size in {len(t) for t in terms}:
                pairs = sorted((hashed(t), base + i) for i, t in enumerate(terms) if len(t) == size)
                self.by_length[whole, size] = np.array([h for h, _ in pairs], flat.U), np.array([i for _, i in pairs])
        self.fuzzy = [t for t in sorted(self.words) if len(t) >= 5]
        self.trie = Trie(self.fuzzy)
        place = {t: i for i, t in enumerate(sorted(self.words))}
        self.fuzzy_id = [place[t] for t in self.fuzzy]
        # pieces: (size, start, length) of a word; within k edits one of k+1 pieces of a term survives,
        # shifted by k at most; the first stands at the start, the last at the end.
        self.pieces: dict[tuple[int, int, int], set[int]] = {}
        for t in self.fuzzy:
            k, n = allowed(len(t)), len(t)
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            for size in range(n - k, n + k + 1):
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    for shift in (0,) if a == 0 else (size - n,) if b == n else range(-k, k + 1):
                        if a + shift >= 0 and b + shift <= size:
                            self.pieces.setdefault((size, a + shift, b - a), set()).add(hashed(t[a:b]))
        self.piece_arrays = {key: np.array(sorted(v), flat.U) for key, v in self.pieces.items()}
        self.seen: dict[str, tuple[int, float]] = {}

    def misspelt(self, word: str) -> tuple[int, float]:
        """The term that ``word`` misspells and its weight there, or -1 and 0."""
        if word not in self.seen:
            if len(self.seen) > 300_000:
                self.seen.clear()
            near = [] if word in self.ordinary else self.trie.within(word, allowed(len(word) + 2))
            found = [(float(self.weight[self.fuzzy_id[i]]) * SPELLING**e, -self.fuzzy_id[i]) for e, i in near if 0 < e <= allowed(len(self.fuzzy[i]))]
            weight, term = max(found, default=(0.0, 1))
            self.seen[word] = -term, weight
        return self.seen[word]


def allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 10 else 2


_CODE: list[np.ndarray] = []


def bpe_code() -> np.ndarray:
    if not _CODE:
        _CODE.append(flat._stream(0x110000, 71))
    return _CODE[0]


_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([WORD.match(chr(c)) is not None for c in range(0x110000)]))
    return _LETTER[0]


def _hashes(points, starts, ends, code):
    """Hash of any span inside words that lie in a row, from one pass of running sums."""
    n = len(points)
    total = np.concatenate((np.zeros(1, flat.U), np.cumsum(code[points] * flat._powers(flat.BASE, n), dtype=flat.U)))
    inverse = flat._powers(flat.BASE_INVERSE, n + 1)
    return lambda s, e: flat.mix((total[e] - total[s]) * inverse[s] + (e - s).astype(flat.U))


def features(texts: list[str | None], lexicon: Lexicon, misspelt: list[tuple[int, str]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of ``texts`` and the hits of each; to ``misspelt`` goes each misspelling with its row."""
    n = len(texts)
    lowered = [(t or "").lower() for t in texts]
    offsets = np.cumsum([0, *map(len, lowered)])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((n, FEATURES))
    out[:, 0] = 1
    if not len(points) or not lexicon.terms:
        return out, np.zeros(n, np.int64)
    letter = letters()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], letter[:-1]))
    after = np.concatenate((letter[1:], [False]))
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    if not len(starts):
        return out, np.zeros(n, np.int64)
    code = bpe_code()
    hashes = flat.span_hash(points, starts, ends, code)
    order = np.argsort(hashes)
    first, times = flat.runs(hashes[order])
    example = order[first]
    slot = np.empty(len(hashes), np.int64)
    slot[order] = np.repeat(np.arange(len(first)), times)
    size = (ends - starts)[example]
    chars = points[bpe.spread(starts[example], size)]
    at = np.cumsum(size) - size
    span = _hashes(chars, at, at + size, code)
    term = np.full(len(example), -1)
    worth = np.zeros(len(example))
    exact = np.zeros(len(example), bool)
    for (whole, length), (known, ids) in lexicon.by_length.items():
        fits = np.flatnonzero(size == length if whole else size >= length)
        h = span(at[fits], at[fits] + length)
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        ok = known[place] == h
        fits, ids = fits[ok], ids[place[ok]]
        exact[fits] |= whole
        better = lexicon.weight[ids] > worth[fits]
        term[fits[better]], worth[fits[better]] = ids[better], lexicon.weight[ids[better]]
    near = np.zeros(len(example), bool)
    for (long, begin, length), known in lexicon.piece_arrays.items():
        fits = np.flatnonzero((size == long) & ~exact & ~near)
        near[fits] = np.isin(span(at[fits] + begin, at[fits] + begin + length), known)
    spelt: dict[int, str] = {}
    for i in np.flatnonzero(near).tolist():
        word = chars[at[i] : at[i] + size[i]].tobytes().decode("utf-32-le", "surrogatepass")
        found, weight = lexicon.misspelt(word)
        if weight > worth[i]:
            term[i], worth[i], spelt[i] = found, weight, word
    if misspelt is not None and spelt:
        some = np.flatnonzero(np.isin(slot, list(spelt)))
        rows = np.searchsorted(offsets, starts[some], "right") - 1
        misspelt.extend((r, spelt[i]) for r, i in sorted(set(zip(rows.tolist(), slot[some].tolist(), strict=True))))
    hit = np.flatnonzero(term[slot] >= 0)
    if not len(hit):
        return out, np.zeros(n, np.int64)
    row = np.searchsorted(offsets, starts[hit], "right") - 1
    ids, weight = term[slot[hit]], worth[slot[hit]]
    quote = np.flatnonzero(np.isin(points, [ord(c) for c in QUOTES]))
    quoted = np.zeros(len(hit), bool)
    if len(quote):
        i = np.searchsorted(quote, starts[hit])
        left, right = quote[np.maximum(i - 1, 0)], quote[np.minimum(i, len(quote) - 1)]
        quoted = (i > 0) & (i < len(quote)) & (left >= np.maximum(starts[hit] - NEAR, offsets[row])) & (right < np.minimum(ends[hit] + NEAR, offsets[row + 1]))
    plain = ~quoted
    pairs, which = np.unique(row[plain] * len(lexicon.terms) + ids[plain], return_inverse=True)
    most = np.zeros(len(pairs))  # a term counts once for each document, as spelt best
    np.maximum.at(most, which, weight[plain])
    words = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=n)
    total = np.bincount(pairs // len(lexicon.terms), most, n)
    np.maximum.at(out[:, 1], row[plain], weight[plain])
    out[:, 2] = np.minimum(total, 60)
    out[:, 3] = np.log1p(np.bincount(row[plain], minlength=n))
    out[:, 4] = np.log1p(np.bincount(row[quoted], minlength=n))
    out[:, 5] = np.log1p(100 * np.bincount(row[plain], minlength=n) / np.maximum(words, 1))
    out[:, 6] = np.log1p(words)
    return out, np.bincount(row, minlength=n)


def _chance(p: int, q: int, share: float) -> float:
    """How likely p or more of p + q documents are toxic if ``share`` of all are."""
    n = p + q
    ways = math.lgamma(n + 1)
    return math.fsum(math.exp(ways - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)) for k in range(p, n + 1))


def _odds(p: int, q: int, positives: int, negatives: int) -> float:
    return math.log((p + 0.5) / (positives + 1)) - math.log((q + 0.5) / (negatives + 1))


def _choose(counts: dict[tuple[str, str], tuple[int, int]], positives: int, negatives: int) -> Lexicon:
    """Terms from (kind, text) -> documents that have it, toxic and other."""
    chosen: dict[str, dict[str, float]] = {"word": {}, "stem": {}}
    share = positives / (positives + negatives + 1)
    odds_of = {k: _odds(p, q, positives, negatives) for k, (p, q) in counts.items() if p >= LEAST_ROWS}
    chance = {k: _chance(*counts[k], share) for k, odds in odds_of.items() if odds >= LEAST_ODDS}
    limit = max((x for i, x in enumerate(sorted(chance.values()), 1) if x * len(odds_of) <= i * CHANCE), default=0.0)
    as_many = Counter()  # of each stem, the most toxic documents that a longer stem or a word with it has
    for (kind, text), (p, _) in counts.items():
        if p >= LEAST_ROWS:
            for stem in [text[:-1]] if kind == "stem" else [text[:k] for k in STEMS if k <= len(text)]:
                as_many[stem] = max(as_many[stem], p)
    for (kind, text), (p, q) in sorted(counts.items(), key=lambda x: (x[0][0] != "stem", len(x[0][1]), x[0][1])):
        if chance.get((kind, text), 1.0) > limit or (kind == "stem" and as_many[text] >= p):
            continue
        odds = odds_of[kind, text]
        if any(chosen["stem"].get(text[:k], -9.0) >= odds - NEARLY for k in STEMS if k < len(text)):
            continue  # its stem weighs as much
        chosen[kind][text] = odds
    return Lexicon(chosen["word"], chosen["stem"])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _terms_of(text: str) -> set[tuple[str, str]]:
    words = set(WORD.findall(text.lower()))
    return {("word", w) for w in words if 3 <= len(w) <= 30} | {("stem", w[:k]) for w in words for k in STEMS if len(w) > k}


def _known(text: str, words: set[str], stems: set[str]) -> set[tuple[str, str]]:
    found = set(WORD.findall(text.lower()))
    out = {("word", w) for w in found & words}
    out.update(("stem", w[:k]) for k in STEMS for w in found if w[:k] in stems and len(w) > k)
    return out


_COUNTS = "kind string, term string, fold int, toxic int, n long"
_COUNTS_ARROW = pa.schema([("kind", pa.string()), ("term", pa.string()), ("fold", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])


def _counted(found: Counter) -> pa.RecordBatch:
    """(kind, term, fold, toxic) and their counts as rows; of the same types if there are none."""
    columns = zip(*((*key, n) for key, n in found.items()), strict=True) if found else [()] * len(_COUNTS_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _COUNTS_ARROW, strict=True)], schema=_COUNTS_ARROW)


def _counts(wanted=None):
    """(kind, term, fold, toxic, documents) of each chunk; all terms, or those in the broadcast ``wanted``."""

    def run(batches):
        for batch in batches:
            for first, end, texts in bpe.text_chunks(batch.column("text")):
                found: Counter = Counter()
                for text, toxic, fold in zip(texts, batch.column("toxic").slice(first, end - first).to_pylist(), batch.column("fold").slice(first, end - first).to_pylist(), strict=True):
                    terms = _known(text or "", *wanted.value) if wanted else _terms_of(text or "")
                    found.update((*t, fold, toxic) for t in terms)
                yield _counted(found)

    return run


def _sketched(batches):
    """``sketch``: the least hash of a text's runs of three words, of all its words if it has fewer; near copies mostly share it."""
    for batch in batches:
        out = np.zeros(batch.num_rows, flat.U)
        for first, end, data, offsets in flat.chunks(batch.column("text")):
            starts, ends, rows = flat.words(flat.LOWER[data], offsets)
            hashes = flat.span_hash(flat.LOWER[data], starts, ends)
            grams, owners = flat.grams(hashes, rows, 3)
            few = np.bincount(rows, minlength=end - first)[rows] < 3
            np.add.at(out, first + rows[few], hashes[few])
            out[first + owners] = np.iinfo(flat.U).max
            np.minimum.at(out, first + owners, grams)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*batch.schema.names, "sketch"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns terms and weights from the labelled rows of ``docs``; see the module's text for the bound."""
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long")
    marked = labels.select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marked = marked.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, marked.count()))
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).withColumn("fold", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))).cast("int"))
    rows = docs.select(key.alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most about fit_rows ids
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("fold").alias("fold"))  # of several texts of one id, the first
    rows = materialise(rows.mapInArrow(_sketched, T.StructType([*rows.schema.fields, T.StructField("sketch", T.LongType())])), "labelled")
    once = rows.join(F.broadcast(rows.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")), "doc_id")  # at most about fit_rows ids
    sizes = {(r.fold, r.toxic): r.n for r in once.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    positives = [sizes.get((f, 1), 0) for f in (0, 1)]
    negatives = [sizes.get((f, 0), 0) for f in (0, 1)]
    nothing = Model(Lexicon(), np.array([-40.0] + [0.0] * (FEATURES - 1)))
    if not sum(positives):
        return nothing
    toxic = once.filter("toxic = 1").mapInArrow(_counts(), _COUNTS).groupBy("kind", "term", "fold", "toxic").agg(F.sum("n").alias("n"))
    toxic = toxic.groupBy("kind", "term").agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"p{f}") for f in (0, 1)]).filter(F.col("p0") + F.col("p1") >= LEAST_ROWS)
    found = {(r.kind, r.term): (r.p0, r.p1) for r in toxic.collect()}  # terms of at most about fit_rows rows
    wanted = spark.sparkContext.broadcast(tuple({t for k, t in found if k == kind} for kind in ("word", "stem")))
    other = once.filter("toxic = 0").mapInArrow(_counts(wanted), _COUNTS).groupBy("kind", "term").agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"q{f}") for f in (0, 1)])
    clean = {(r.kind, r.term): (r.q0, r.q1) for r in other.collect()}
    by_fold = [_choose({t: (p[f], clean.get(t, (0, 0))[f]) for t, p in found.items()}, positives[f], negatives[f]) for f in (0, 1)]
    whole = _choose({t: (sum(p), sum(clean.get(t, (0, 0)))) for t, p in found.items()}, sum(positives), sum(negatives))
    if not whole.terms:
        return nothing
    drafts = spark.sparkContext.broadcast([(x.words, x.stems) for x in (*by_fold, whole)])

    def near_words(batches):
        lexicons = [Lexicon(*x) for x in drafts.value]
        for batch in batches:
            for first, end, texts in bpe.text_chunks(batch.column("text")):
                toxic, fold = (batch.column(c).slice(first, end - first).to_pylist() for c in ("toxic", "fold"))
                found: Counter = Counter()
                for k, lexicon in enumerate(lexicons):
                    words: list[tuple[int, str]] = []
                    features(texts, lexicon, words)
                    found.update(("near", w, k, toxic[r]) for r, w in words if k == 2 or fold[r] == k)
                yield _counted(found)

    seen = once.mapInArrow(near_words, _COUNTS).groupBy("term", "fold").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(n) for n, y in (("p", 1), ("q", 0))])
    ordinary: list[set[str]] = [set(), set(), set()]
    for r in seen.filter("q > 0").collect():  # words of at most about fit_rows rows
        if _odds(r.p, r.q, *((positives[r.fold], negatives[r.fold]) if r.fold < 2 else (sum(positives), sum(negatives)))) < LEAST_ODDS:
            ordinary[r.fold].add(r.term)
    by_fold = [Lexicon(x.words, x.stems, frozenset(o)) for x, o in zip(by_fold, ordinary, strict=False)]
    whole = Lexicon(whole.words, whole.stems, frozenset(ordinary[2]))
    shared = spark.sparkContext.broadcast([(x.words, x.stems, x.ordinary) for x in by_fold])

    def train(batches):
        lexicons = [Lexicon(*x) for x in shared.value]
        for batch in batches:
            for first, end, texts in bpe.text_chunks(batch.column("text")):
                fold = batch.column("fold").slice(first, end - first).to_numpy()
                made = np.where((fold == 0)[:, None], features(texts, lexicons[1])[0], features(texts, lexicons[0])[0])
                yield pa.RecordBatch.from_arrays([pa.array(list(made)), batch.column("toxic").slice(first, end - first)], names=["x", "toxic"])

    sample = rows.mapInArrow(train, "x array<double>, toxic int").collect()  # at most about fit_rows rows
    x, y = np.array([r.x for r in sample]), np.array([float(r.toxic) for r in sample])
    return Model(whole, _logistic(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``n_hits``."""
    docs = docs.drop("score", "n_hits")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.lexicon.ordinary, model.weights))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())])

    def run(batches):
        own = Model(Lexicon(*shared.value[:3]), shared.value[3])
        for batch in batches:
            for first, end, texts in bpe.text_chunks(batch.column("text")):
                rows, hits = features(texts, own.lexicon)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(own.score(rows)), pa.array(hits, pa.int64())], names=[*names, "score", "n_hits"])

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
