"""N-gram Jaccard join by prefix filtering under several global token orders.

A document's set holds the hashes of its distinct five-word shingles; documents with equal sets form a
class, and the join works on classes. Two classes link when their Jaccard similarity reaches the
threshold t. If they do, they share a token in the first n - ceil(t n) + 1 tokens of each, under *every*
global order of tokens. The orders used all put first the tokens that only one class has, then

1. rarest first (exact class counts of every token, ties by hash),
2. and 3. by two independent hashes.

Postings of all tokens are counted once, packed by token partition. A class whose shared tokens cannot
fill its prefix has no link and leaves at once. Order 1 proposes candidates: classes with a common
prefix token form a bucket. A candidate pair must then share prefix tokens under orders 2 and 3, have
sizes that allow the threshold, and pass the exact comparison of the whole sets.

Only components are asked for, so a bucket need not be compared pair by pair: every class is compared
with a leader of each of its buckets, first with one leader for all of a class's rarest buckets, then
with a leader of each bucket that still holds several components. All pairs of classes of one
bucket that are still in different components after that are then compared, none left out, block against
block in memory: their number is about that of the classes outside the largest component of their
group times the size of the group. Pairs within a component are never made.

Cases: a null or empty text, or one of white space, has an empty set, links with nothing and is its own
component; fewer than five words are one shingle; repeated rows fall into one class; a row with a null
doc_id takes the component of the rows with its set, and links nothing itself; no rows give no rows. Input columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .components import components
from .store import materialise, partitions_for

SIZE = 5
CHUNK_BYTES = 2 << 20
PERCENT = 80
BROADCAST_ROWS = 1_000_000
STARS = 8
BLOCK = 256
ROWS_PER_PART = 100_000
SALTS = 8
_PACKED = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_PACKED_DDL = "part int, owners binary, sizes binary, counts binary, keys binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of lower-cased texts, by row and hash."""
    data = flat.LOWER[data]
    starts, ends, rows = flat.words(data, offsets)
    word_hash = flat.span_hash(data, starts, ends)
    keys, owners = flat.grams(word_hash, rows, size)
    first, many = flat.runs(rows)
    short = np.flatnonzero(many < size)
    if len(short):
        total = np.zeros(len(short), flat.U)
        for i in range(size - 1):
            has = many[short] > i
            total[has] += word_hash[first[short][has] + i] * flat.POSITION_CODE[i]
        owners = np.concatenate((owners, rows[first[short]]))
        keys = np.concatenate((keys, flat.mix(total + many[short].astype(flat.U))))
    return flat.unique_pairs(owners, keys)


def _classes(rows, keys, n):
    """Size and class of each of ``n`` rows; the class is a hash of the set, 0 for an empty one."""
    count = np.bincount(rows, minlength=n)
    total = np.zeros(n, flat.U)
    at, many = flat.runs(rows)
    if len(at):
        total[rows[at]] = flat.mix(np.add.reduceat(flat.mix(keys ^ flat.U(0x5851F42D4C957F2D)), at) + many.astype(flat.U))
    return count, total.view(np.int64)


def _label(size):
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in flat.chunks(batch.column("text"), CHUNK_BYTES):
                count, kind = _classes(*shingle_sets(data, offsets, size), end - first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(count, pa.int64()), pa.array(kind)], names=["doc_id", "n_shingles", "class"])

    return run


def _pack(part, owner, sizes, keys):
    order = np.argsort(part, kind="stable")
    part, owner, sizes, keys = part[order], owner[order], sizes[order], keys[order]
    starts, lengths = flat.runs(part)
    out: list[list] = [[], [], [], [], []]
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        at, count = flat.runs(owner[s : s + n])
        for column, value in zip(out, (int(part[s]), owner[s + at].tobytes(), sizes[s + at].astype(np.int32).tobytes(), count.astype(np.uint32).tobytes(), keys[s : s + n].tobytes()), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PACKED, strict=True)], schema=_PACKED)


def _unpack(batches, key_type):
    """Owner, size and length of each run, and all keys."""
    part, found = -1, [[np.zeros(0, t)] for t in (np.int64, np.int32, np.uint32, key_type)]
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("part", "owners", "sizes", "counts", "keys")), strict=True):
            part = row[0].as_py()
            for to, value, kind in zip(found, row[1:], (np.int64, np.int32, np.uint32, key_type), strict=True):
                to.append(np.frombuffer(value.as_buffer(), kind))
    return part, *(np.concatenate(x) for x in found)


def _postings(size, partitions):
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in flat.chunks(batch.column("text"), CHUNK_BYTES):
                rows, keys = shingle_sets(data, offsets, size)
                count, kind = _classes(rows, keys, len(offsets) - 1)
                once = np.zeros(len(count), bool)
                once[np.unique(kind, return_index=True)[1]] = True  # copies within a chunk
                rows, keys = rows[once[rows]], keys[once[rows]]
                yield _pack((keys % flat.U(partitions)).astype(np.int32), kind[rows], count[rows], (keys >> flat.U(32)).astype(np.uint32))

    return run


def _shared(partitions):
    """Of each token that several classes have, a posting to each class: how many have it, then a hash."""

    def run(batches):
        part, owner, sizes, counts, keys = _unpack(batches, np.uint32)
        if not len(owner):
            return
        _, first = np.unique(owner, return_index=True)  # a class comes once from each chunk that has it
        keep = np.zeros(len(owner), bool)
        keep[first] = True
        keys = keys[np.repeat(keep, counts)]
        owner, sizes, counts = owner[keep], sizes[keep], counts[keep]
        run_of = np.repeat(np.arange(len(owner), dtype=np.int32), counts)
        order = np.argsort(keys, kind="stable")
        keys, run_of = keys[order], run_of[order]
        starts, lengths = flat.runs(keys)
        if not len(starts):
            return
        several = np.repeat(np.minimum.reduceat(run_of, starts) < np.maximum.reduceat(run_of, starts), lengths)
        holders = np.minimum(np.repeat(lengths, lengths)[several], (1 << 20) - 1).astype(flat.U)
        token = flat.mix(keys[several].astype(flat.U) * flat.U(partitions) + flat.U(part)) >> flat.U(20)
        run_of = run_of[several]
        order = np.argsort(run_of, kind="stable")
        run_of, value = run_of[order], ((holders << flat.U(44)) | token)[order]
        owner, sizes = owner[run_of], sizes[run_of]
        to = (flat.mix(owner.view(flat.U)) % flat.U(partitions)).astype(np.int32)
        for at in range(0, max(1, len(value)), 1 << 20):
            s = slice(at, at + (1 << 20))
            yield _pack(to[s], owner[s], sizes[s], value[s])

    return run


def _prefixes(percent):
    schema = pa.schema([("class", pa.int64()), ("n", pa.int32()), *((f"p{i}", pa.list_(pa.int64())) for i in (1, 2, 3))])

    def run(batches):
        _, owner, sizes, counts, value = _unpack(batches, flat.U)
        if not len(owner):
            return
        size = np.repeat(sizes, counts)
        owner = np.repeat(owner, counts)
        order = np.lexsort((value, owner))
        owner, value, size = owner[order], value[order], size[order]
        starts, shared = flat.runs(owner)
        n = size[starts].astype(np.int64)
        rest = n - (n * percent + 99) // 100 + 1 - (n - shared)  # prefix places left after the tokens of one class only
        keep = rest > 0
        starts, shared, n, rest = starts[keep], shared[keep], n[keep], rest[keep]
        orders = []
        for salt in (None, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
            by = value if salt is None else flat.mix(value ^ flat.U(salt))
            ranked = value if salt is None else value[np.lexsort((by, owner))]
            take = np.arange(int(rest.sum())) - np.repeat(np.cumsum(rest) - rest, rest) + np.repeat(starts, rest)
            orders.append((np.append(0, np.cumsum(rest)), ranked[take].view(np.int64)))
        for at in range(0, len(n), 2000):
            end = min(len(n), at + 2000)
            lists = [pa.ListArray.from_arrays(pa.array(b[at : end + 1] - b[at], pa.int32()), pa.array(v[b[at] : b[end]])) for b, v in orders]
            yield pa.RecordBatch.from_arrays([pa.array(owner[starts[at:end]]), pa.array(n[at:end], pa.int32()), *lists], schema=schema)

    return run


def _set_blobs(size):
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in flat.chunks(batch.column("text"), CHUNK_BYTES):
                rows, keys = shingle_sets(data, offsets, size)
                count, kind = _classes(rows, keys, end - first)
                bounds = np.append(0, np.cumsum(count)) * 8
                blobs = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(keys.tobytes())])
                right = pa.array(kind == batch.column("class").slice(first, end - first).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(kind), blobs], names=["class", "tokens"]).filter(right)

    return run


def _verify(percent):
    """Of candidate pairs, those whose whole sets reach the threshold."""

    def meet(a, b):
        return len(np.intersect1d(a, b, assume_unique=True))

    def run(batches):
        for batch in batches:
            sets = {s: batch.column(s) for s in ("tokens_a", "tokens_b")}
            hit = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), flat.U) for c in sets.values())
                both = meet(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    hit.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    return run


def _incidence(lists_a, lists_b, wide=1 << 13):
    """How many tokens each list of ``lists_a`` shares with each of ``lists_b``."""
    out = np.zeros((len(lists_a), len(lists_b)), np.float32)
    sides = []
    for lists in (lists_a, lists_b):
        sides.append((np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*lists, lists[0][:0]])))
    common = np.intersect1d(sides[0][1], sides[1][1])
    for at in range(0, len(common), wide):
        part = common[at : at + wide]
        made = []
        for (rows, tokens), n in zip(sides, out.shape, strict=True):
            place = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
            ok = part[place] == tokens
            table = np.zeros((n, len(part)), np.float32)
            table[rows[ok], place[ok]] = 1
            made.append(table)
        out += made[0] @ made[1].T
    return out


def _meet(percent):
    """Of two blocks, the links between classes of different components, by one a component pair is joined."""

    def side(row):
        m = row.values
        get = {f.name: m.field(i) for i, f in enumerate(m.type)}
        sets = [np.frombuffer(x.as_buffer(), flat.U) for x in get["tokens"]]
        return get["class"].to_numpy(), get["component"].to_numpy(), sets, [[x.values.to_numpy() for x in get[p]] for p in ("p1", "p2", "p3")]

    def run(batches):
        for batch in batches:
            found = [[np.zeros(0, np.int64)] for _ in range(2)]
            for i in range(batch.num_rows):
                ids_a, in_a, sets_a, orders_a = side(batch.column("m_a")[i])
                ids_b, in_b, sets_b, orders_b = side(batch.column("m_b")[i])
                n_a, n_b = (np.array([len(x) for x in s]) for s in (sets_a, sets_b))
                may = (in_a[:, None] != in_b[None, :]) & (100 * n_a[:, None] >= percent * n_b[None, :]) & (100 * n_b[None, :] >= percent * n_a[:, None])
                for x, y in zip(orders_a, orders_b, strict=True):
                    if may.any():
                        may &= _incidence(x, y) > 0
                if not may.any():
                    continue
                rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                both = _incidence([sets_a[r] for r in rows], [sets_b[c] for c in columns]).astype(np.int64)
                hit = may[np.ix_(rows, columns)] & (100 * both >= percent * (n_a[rows][:, None] + n_b[columns][None, :] - both))
                r, c = np.nonzero(hit)
                x, y = in_a[rows[r]], in_b[columns[c]]
                # one link joins a pair of components; the others between the same two add nothing
                _, once = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1, return_index=True) if len(x) else (None, r)
                found[0].append(ids_a[rows[r[once]]])
                found[1].append(ids_b[columns[c[once]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, percent
        n = partitions_for(docs, 24)
        self.labels = materialise(self.docs.mapInArrow(_label(size), "doc_id long, n_shingles long, class long"), "labels")
        # copies of one text are one row from here on: minima are taken before rows are dealt by class
        self.classes = materialise(self.labels.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc")), "classes")
        shared = self.docs.select("text").mapInArrow(_postings(size, n), _PACKED_DDL).repartitionById(n, F.col("part")).mapInArrow(_shared(n), _PACKED_DDL)
        prefixes = shared.repartitionById(n, F.col("part")).mapInArrow(_prefixes(percent), "class long, n int, p1 array<long>, p2 array<long>, p3 array<long>")
        self.prefixes = materialise(prefixes, "prefixes")
        self.sets = materialise(self._sets(), "sets")
        self.buckets = materialise(self.prefixes.select("class", "n", F.posexplode("p1").alias("place", "token")), "buckets")
        self.parts = max(8, self.buckets.count() // ROWS_PER_PART)
        self.links: DataFrame | None = None
        self.found: DataFrame | None = None

    def _sets(self) -> DataFrame:
        """Whole sets of the classes with a prefix, from one text of each."""
        few = self.prefixes.select("class")
        reps = materialise(self.classes.join(few, "class").filter("doc is not null").select("class", F.col("doc").alias("doc_id")), "reps")
        wanted = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps
        texts = self.docs.join(wanted, "doc_id").mapInArrow(_set_blobs(self.size), "class long, tokens binary")
        once = texts.dropDuplicates(["class"]) if self.repeated_ids() else texts
        return once.join(self.prefixes.select("class", "p1", "p2", "p3"), "class")

    def repeated_ids(self) -> bool:
        counts = self.labels.filter("doc_id is not null").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
        return counts.n > counts.d

    def compare(self, pairs: DataFrame) -> None:
        """Adds the links among ``pairs`` (a, b), which share a prefix token under order 1, and joins the components anew.

        The filters of orders 2 and 3 are intersected on the prefixes alone; whole sets move only for pairs that pass all three.
        """

        def met(side, *columns):
            return self.sets.select(F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

        orders = pairs.join(met("a", "p2", "p3"), "a").join(met("b", "p2", "p3"), "b")
        passed = orders.filter(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b")
        passed = materialise(passed, "passed", self.parts)
        self.join_links(passed.join(met("a", "tokens"), "a").join(met("b", "tokens"), "b").mapInArrow(_verify(self.percent), "a long, b long"))

    def join_links(self, found: DataFrame) -> None:
        new = materialise(found, "links", self.parts)
        self.links = new if self.links is None else self.links.union(new)
        self.found = materialise(components(self.links), "found", self.parts)

    def placed(self) -> DataFrame:
        """Buckets with the component of each class."""
        known = self.found.select(F.col("node").alias("class"), "component")
        return self.buckets.join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))

    def fits(self, n: str, m: str):
        return (F.col(n) * 100 >= F.col(m) * self.percent) & (F.col(m) * 100 >= F.col(n) * self.percent)

    def run(self) -> DataFrame:
        rank = F.struct(F.xxhash64("class").alias("h"), F.col("class").alias("c"), F.col("n").alias("m"))
        few = self.buckets.filter(F.col("place") < STARS)
        leaders = materialise(few.groupBy("token").agg(F.min(rank).alias("lead"), F.count("*").alias("k")).filter("k > 1").select("token", "lead.c", "lead.m"), "leaders", self.parts)
        stars = few.join(leaders, "token").filter(F.col("c") != F.col("class")).filter(self.fits("n", "m"))
        self.compare(materialise(stars.select(F.col("c").alias("a"), F.col("class").alias("b")).distinct(), "stars", self.parts))

        open_buckets = materialise(self.mixed(self.placed()), "open", self.parts)
        rank = F.struct(F.xxhash64("class", "token").alias("h"), F.col("class").alias("c"), F.col("n").alias("m"), F.col("component").alias("d"))
        leaders = materialise(open_buckets.groupBy("token").agg(F.min(rank).alias("lead")).select("token", "lead.c", "lead.m", "lead.d"), "leaders", self.parts)
        stars = open_buckets.join(leaders, "token").filter("component != d").filter(self.fits("n", "m"))
        self.compare(materialise(stars.select(F.greatest("c", "class").alias("a"), F.least("c", "class").alias("b")).distinct(), "stars", self.parts))

        last = materialise(self.mixed(self.placed()), "open", self.parts)
        if not last.isEmpty():
            self.join_links(self.blocks(last))
        return self.result()

    def blocks(self, last: DataFrame) -> DataFrame:
        """Links among all pairs of classes that share one of the buckets ``last`` and are in different components.

        Classes are dealt to blocks of about ``BLOCK``: first by the fullest bucket they are in, then, where a
        component fills blocks of its own, by component. Blocks that share a bucket meet once; two blocks
        wholly of one component do not meet. A meeting counts overlaps as products of incidence matrices.
        """
        full = materialise(last.groupBy("token").agg(F.count("*").alias("k")), "full", self.parts)
        home = last.join(full, "token").groupBy("class", "component").agg(F.max(F.struct("k", "token")).alias("best"))
        home = materialise(home.select("class", "component", F.col("best.token").alias("home")), "home", self.parts)
        large = home.groupBy("home", "component").agg(F.count("*").alias("many"))
        own = F.when(F.col("many") >= BLOCK, F.col("component"))
        home = materialise(home.join(materialise(large, "large"), ["home", "component"]).withColumn("own", own), "home", self.parts)
        sizes = home.groupBy("home", "own").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        sizes = materialise(sizes.withColumn("of", F.xxhash64("home", F.coalesce("own", F.lit(0)), F.col("own").isNull())), "sizes", self.parts)
        dealt = home.withColumn("of", F.xxhash64("home", F.coalesce("own", F.lit(0)), F.col("own").isNull())).join(sizes.select("of", "parts"), "of")
        dealt = materialise(dealt.select("class", "component", F.xxhash64("of", F.pmod(F.xxhash64("class"), F.col("parts"))).alias("block")), "dealt", self.parts)
        seen = materialise(last.join(dealt.select("class", "block"), "class").groupBy("block", "token").agg(F.count("*").alias("k")), "seen", self.parts)
        pure = dealt.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        pure = materialise(pure.withColumn("only", F.when(F.col("x") == F.col("y"), F.col("x"))).select("block", "only"), "pure", self.parts)
        pairs = seen.select("token", F.col("block").alias("a")).join(seen.select("token", F.col("block").alias("b")), "token").filter("a <= b").select("a", "b").distinct()
        pairs = pairs.join(pure.toDF("a", "only_a"), "a").join(pure.toDF("b", "only_b"), "b").filter("not coalesce(only_a = only_b, false)").select("a", "b")
        packed = dealt.join(self.sets, "class").groupBy("block").agg(F.collect_list(F.struct("class", "component", "tokens", "p1", "p2", "p3")).alias("m"))  # about BLOCK classes
        packed = materialise(packed, "blocks")
        met = materialise(pairs, "meetings", self.parts).join(packed.toDF("a", "m_a"), "a").join(packed.toDF("b", "m_b"), "b")
        return met.select("m_a", "m_b").mapInArrow(_meet(self.percent), "a long, b long")

    def mixed(self, placed: DataFrame) -> DataFrame:
        """The rows of buckets that hold classes of several components."""
        tokens = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("token")
        return placed.join(materialise(tokens, "tokens", self.parts), "token", "left_semi").select("class", "n", "token", "component")

    def result(self) -> DataFrame:
        known = self.found.select(F.col("node").alias("class"), "component")
        classes = self.classes.join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
        classes = materialise(classes, "placed")
        least = classes.groupBy("component").agg(F.min("doc").alias("component_id"))
        classes = materialise(classes.join(least, "component").select("class", "component_id"), "named")
        empty = self.labels.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = self.labels.filter("n_shingles > 0").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # copies of one text are no single task's
        return salted.join(classes.select("*", salts), ["class", "salt"]).select("doc_id", "n_shingles", "component_id").union(empty)


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; component_id: the smallest doc_id reachable by links."""
    return _Join(docs, size, percent).run()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - math.ceil(n * percent / 100) + 1


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE_SQL = {
    "op5_jaccard_join": r"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS k FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
    SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = t.doc_id) AS component_id
    FROM t LEFT JOIN n USING (doc_id)"""
}
