"""Substring deduplication with a log-structured index of window fingerprints.

A window is 13 consecutive words of one document. A word goes when a window that covers it also
starts in a document with a smaller id; windows are judged on the input. New documents arrive in
batches. The index keeps, for all earlier batches, sorted immutable runs of window fingerprints:

1. Fingerprints. Of each window the smallest hash among its nine 5-word runs is kept. Equal windows
   have equal fingerprints, and neighbouring windows mostly share one, so about a fifth of the
   positions is stored. Runs are split by fingerprint into a fixed number of partitions.
2. Merge join. The sorted runs and the batch meet partition by partition. A fingerprint found in two
   or more documents makes their windows candidates.
3. Verification. Candidates are hashed over all 13 words and compared with the windows of the
   documents, old or new, that share the fingerprint. Windows are one if hash and fingerprint agree (128 bits).
   The smallest document id of each window decides.
4. Removal, one pass over the batch's texts.
5. The batch's fingerprints are appended as a run; more than ``most_runs`` runs are merged into one, over more partitions where
   the index has outgrown them.

Runs lie in generations of files below one path, and a manifest names those that count: an index can be opened again, and a
write that failed leaves it as it was. Sorted runs are concatenated and sorted by a stable sort, which finds the runs and
merges them.

Cases: a null or empty text has no words and passes as an empty text; texts of fewer than 13 words
keep all words; rows with one doc_id count as one document, so they never remove each other's words;
a null doc_id passes with its words joined by single spaces; no rows give no rows. Other columns of the
input pass through unchanged (``text`` is replaced), and columns named ``n_words``, ``n_removed`` or
with a leading ``_ll_`` are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .store import materialise, partitions_for, shared_dir

WINDOW = 13
ANCHOR = 5
ROW_KEYS = 1 << 20
PART_KEYS = 4 << 20
MARKS = 1 << 24
MANIFEST = "made long, partitions long, keys long, runs array<string>"
_OWN = pa.schema([("doc_id", pa.int64()), ("_ll_keys", pa.binary())])


def _fingerprints(data, offsets):
    """Window hashes, their fingerprints, their rows, and the words they are made of."""
    starts, ends, rows = flat.words(data, offsets)
    word_hash = flat.span_hash(data, starts, ends)
    hashes, at = flat.grams(word_hash, rows, WINDOW)
    n = len(rows) - WINDOW + 1
    if n <= 0 or not len(hashes):
        return hashes, hashes, at, (starts, ends, rows)
    m = len(rows) - ANCHOR + 1
    gram = word_hash[:m] * flat.POSITION_CODE[32]
    for i in range(1, ANCHOR):
        gram = gram + word_hash[i : i + m] * flat.POSITION_CODE[32 + i]
    gram = flat.mix(gram)
    least = gram[:n].copy()
    for i in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least, gram[i : i + n], out=least)
    return hashes, least[rows[:n] == rows[WINDOW - 1 :]], at, (starts, ends, rows)


def _tag(keys, rows):
    """One number for a key and the row that it is asked for."""
    return flat.mix(keys + (rows.astype(flat.U) + flat.U(1)) * flat.U(0x9E3779B97F4A7C15))


def _given(column, first, end):
    """Tags of the keys listed for rows first..end."""
    keys, rows = [np.zeros(0, flat.U)], [np.zeros(0, np.int64)]
    for i, blob in enumerate(column.slice(first, end - first)):
        if blob.is_valid:
            keys.append(np.frombuffer(blob.as_buffer(), flat.U))
            rows.append(np.full(len(keys[-1]), i, np.int64))
    return _tag(np.concatenate(keys), np.concatenate(rows))


def _ids(batch, first, end):
    column = batch.column("doc_id").slice(first, end - first)
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _anchor_postings(partitions):
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in flat.chunks(batch.column("text")):
                _, keys, rows, _ = _fingerprints(data, offsets)
                ids, real = _ids(batch, first, end)
                rows, keys = flat.unique_pairs(rows, keys)
                use = real[rows]
                yield flat.pack(ids[rows[use]], keys[use], partitions)

    return run


def _window_postings(partitions):
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in flat.chunks(batch.column("text")):
                hashes, keys, rows, _ = _fingerprints(data, offsets)
                hit = np.isin(_tag(keys, rows), _given(batch.column("_ll_keys"), first, end))
                ids, _ = _ids(batch, first, end)
                rows, hashes, keys = rows[hit], hashes[hit], keys[hit]
                order = np.lexsort((hashes, keys, rows))
                rows, hashes, keys = rows[order], hashes[order], keys[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])
                yield flat.pack(ids[rows[new]], hashes[new], partitions, others=keys[new])

    return run


def _grouped(batches):
    owners, keys = flat.unpack(batches)
    order = np.argsort(keys, kind="stable")  # sorted runs are merged
    owners, keys = owners[order], keys[order]
    starts, lengths = flat.runs(keys)
    return owners, keys, starts, lengths


def _by_owner(owners, keys, partitions):
    order = np.argsort(owners, kind="stable")
    return flat.pack(owners[order], keys[order], partitions, by_owner=True)


def _shared(partitions):
    """For each document, its keys that another document has too."""

    def run(batches):
        owners, keys, starts, lengths = _grouped(batches)
        if len(starts):
            twice = np.repeat(np.minimum.reduceat(owners, starts) < np.maximum.reduceat(owners, starts), lengths)
            yield _by_owner(owners[twice], keys[twice], partitions)

    return run


def _later(partitions):
    """For each document, its keys that a document with a smaller id has too."""

    def run(batches):
        owners, keys, others = flat.unpack(batches, "others")
        order = np.lexsort((others, keys))
        owners, keys, others = owners[order], keys[order], others[order]
        if len(keys):
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (others[1:] != others[:-1]))))
            later = owners > np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(keys))))
            yield _by_owner(owners[later], keys[later], partitions)

    return run


def _lists(batches):
    """One row for each document with all its keys."""
    owners, keys = flat.unpack(batches)
    order = np.argsort(owners, kind="stable")
    owners, keys = owners[order], keys[order]
    starts, lengths = flat.runs(owners)
    for at in range(0, len(starts), 5000):
        blobs = [keys[s : s + n].tobytes() for s, n in zip(starts[at : at + 5000].tolist(), lengths[at : at + 5000].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(owners[starts[at : at + 5000]], pa.int64()), pa.array(blobs, pa.binary())], schema=_OWN)


def _dealt(partitions):
    """Packed postings of runs, dealt out anew."""

    def run(batches):
        for batch in batches:
            yield flat.pack(*flat.unpack([batch]), partitions)

    return run


def _sorted_run(batches):
    """Packed rows of at most ``ROW_KEYS`` keys, sorted by key, for the parts of a partition."""
    rows = [batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)]
    for part in sorted({row.column("part")[0].as_py() for row in rows}):
        owners, keys, _, _ = _grouped([row for row in rows if row.column("part")[0].as_py() == part])
        for at in range(0, len(keys), ROW_KEYS):
            own = owners[at : at + ROW_KEYS]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (own, np.ones(len(own), np.uint32), keys[at : at + ROW_KEYS]))], schema=flat.PACKED_ARROW)


def _removal(columns, schema, untouched):
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in flat.chunks(batch.column("text")):
                hashes, _, rows, (starts, ends, word_rows) = _fingerprints(data, offsets)
                n = end - first
                cover = np.zeros(len(starts) + 1, np.int64)
                if len(rows):
                    hit = np.isin(_tag(hashes, rows), _given(batch.column("_ll_keys"), first, end))
                    # the k-th window of a row starts at its k-th word
                    row_start, _ = flat.runs(rows)
                    order = np.arange(len(rows)) - np.repeat(row_start, np.diff(np.append(row_start, len(rows))))
                    begin = np.searchsorted(word_rows, rows[hit]) + order[hit]
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
                stay = ~gone
                s, e, r = starts[stay], ends[stay], word_rows[stay]
                text, mask = data.copy(), np.zeros(len(data) + 1, np.int8)  # words never overlap
                np.add.at(mask, s, 1)
                np.add.at(mask, e, -1)
                keep = np.cumsum(mask[:-1], dtype=np.int8) > 0
                inner = np.flatnonzero(r[1:] == r[:-1]) + 1 if len(r) else np.zeros(0, np.int64)
                keep[s[inner] - 1] = True  # the white byte before a word that is not its text's first
                text[s[inner] - 1] = 32
                if untouched:
                    whole = np.repeat(np.bincount(word_rows[gone], minlength=n) == 0, np.diff(offsets))
                    keep |= whole
                    text[whole] = data[whole]
                sizes = np.zeros(len(data) + 1, np.int32)
                np.cumsum(keep, dtype=np.int32, out=sizes[1:])
                new = pa.StringArray.from_buffers(n, pa.py_buffer(sizes[offsets].tobytes()), pa.py_buffer(text[keep].tobytes()))
                counts = {"text": new, "n_words": pa.array(np.bincount(word_rows, minlength=n), pa.int64()), "n_removed": pa.array(np.bincount(word_rows[gone], minlength=n), pa.int64())}
                rest = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([counts[c].cast(schema.field(c).type) if c in counts else rest.column(c) for c in columns], names=columns)

    return run


def _marked(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``docs`` with _ll_mark: false only for ids that are not in ``listed``. The bitmap that says so has ``MARKS`` bits, whatever the data."""

    def bit(column):
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(MARKS))

    marks = listed.select(bit(F.col("_ll_id")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_ll_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_ll_bits"))
    place = F.bitmap_bit_position(bit(F.col("doc_id")))
    keyed = docs.withColumn("_ll_bucket", F.bitmap_bucket_number(bit(F.col("doc_id")))).join(F.broadcast(marks), "_ll_bucket", "left")
    byte = F.conv(F.hex(F.substr(F.col("_ll_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return keyed.withColumn("_ll_mark", F.coalesce(F.bit_get(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("_ll_bucket", "_ll_bits")


class SubstringIndex:
    """Sorted runs of window fingerprints below one path, and the rule by which they are used. One writer at a time.

    ``partitions`` counts for a new index only; later it grows with the index, so that a part has about ``PART_KEYS`` keys at most.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, partitions: int = 64, most_runs: int = 4):
        self.spark, self.path, self.most_runs = spark, path or shared_dir(spark, "runs"), most_runs
        known = self._manifest()
        self.partitions, self.keys, self.made, self.runs = (known.partitions, known.keys, known.made, list(known.runs)) if known else (partitions, 0, 0, [])

    def _manifest(self):
        """The manifest with the highest number that was written in full."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(MANIFEST).json(where.toString()).orderBy(F.desc("made")).first()

    def _read(self, names):
        return self.spark.read.schema(flat.PACKED).parquet(*[f"{self.path}/{name}" for name in names])

    def _write(self, postings: DataFrame, partitions: int) -> str:
        """A sorted run, which counts once ``_commit`` has named it."""
        self.made += 1
        name = f"run-{self.made:05d}-{uuid.uuid4().hex[:8]}"
        postings.repartitionById(partitions, F.col("part")).mapInArrow(_sorted_run, flat.PACKED).write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, name: str) -> None:
        runs, partitions = [*self.runs, name], self.partitions
        keys = self.keys + (self._read([name]).agg(F.sum(F.length("keys"))).first()[0] or 0) // 8
        if len(runs) > self.most_runs:
            source = self._read(runs)
            if keys > PART_KEYS * partitions:
                partitions = 2 * keys // PART_KEYS
                source = source.mapInArrow(_dealt(partitions), flat.PACKED)
            runs = [self._write(source, partitions)]
        manifest = self.spark.createDataFrame([(self.made, partitions, keys, runs)], MANIFEST)
        manifest.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self.runs, self.partitions, self.keys = runs, partitions, keys

    def dedup(self, docs: DataFrame, history: DataFrame | None = None, keep_run: bool = True, untouched: bool = False) -> DataFrame:
        """``docs`` with the repeated words cut from ``text``, plus n_words and n_removed.

        ``history``: the documents of earlier batches, whose runs this index holds; without them nothing could be
        verified, so an index with runs asks for them. ``untouched``: a text that
        loses nothing stays as it is, white space included; else all kept words are joined by one space.
        """
        if self.runs and history is None:
            raise ValueError("the index holds runs of earlier documents: give them as history")
        n = self.partitions
        docs = docs.drop("n_words", "n_removed", *[c for c in docs.columns if c.startswith("_ll_")])
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        postings = texts.mapInArrow(_anchor_postings(n), flat.PACKED)
        run = self._write(postings, n) if keep_run else None
        fresh = self._read([run]) if run else postings
        known = fresh.union(self._read(self.runs)) if self.runs else fresh

        def met(source, rule):
            """Postings dealt out by key, judged, dealt out by document and listed."""
            found = source.repartitionById(n, F.col("part")).mapInArrow(rule(n), flat.PACKED)
            return found.repartitionById(n, F.col("part")).mapInArrow(_lists, "doc_id long, _ll_keys binary")

        asked = texts.union(history.select(F.col("doc_id").cast("long"), "text")) if self.runs else texts
        windows = asked.join(met(known, _shared), "doc_id").mapInArrow(_window_postings(n), flat.PAIRED)
        later = materialise(met(windows, _later), "later").withColumnRenamed("doc_id", "_ll_id")
        marked = _marked(docs, later)
        listed = marked.filter("_ll_mark").drop("_ll_mark").join(later, F.col("doc_id").cast("long") == F.col("_ll_id"), "left").drop("_ll_id")
        others = marked.filter("not _ll_mark").drop("_ll_mark").withColumn("_ll_keys", F.lit(None).cast("binary"))  # their texts are not moved
        joined = listed.unionByName(others)
        columns = [*docs.columns, "n_words", "n_removed"]
        schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
        arrow = pa.schema([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
        out = joined.mapInArrow(_removal(columns, arrow, untouched), schema)
        if run:
            self._commit(run)
        return out


def dedup_substrings(docs: DataFrame, batches: int = 2, untouched: bool = False) -> DataFrame:
    """Deduplicates a whole table, fed to a fresh index in ``batches`` by ascending doc_id."""
    index = SubstringIndex(docs.sparkSession, partitions=partitions_for(docs, 32))
    bounds = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if bounds.lo is None or batches < 2:
        return index.dedup(docs, keep_run=False, untouched=untouched)
    step = (bounds.hi - bounds.lo) // batches + 1
    place = (F.col("doc_id").cast("double") - F.lit(float(bounds.lo))) / F.lit(float(step))  # doubles: no overflow, and still in order of the ids
    number = F.coalesce(F.least(F.floor(place), F.lit(batches - 1)), F.lit(0))
    out = None
    for i in range(batches):
        part = index.dedup(docs.filter(number == i), docs.filter(number < i) if i else None, keep_run=i < batches - 1, untouched=untouched)
        out = part if out is None else out.union(part)
    return out


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE_SQL = {
    "op9_substring_dedup": r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM t WHERE len(w) >= 13),
    h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM g),
    f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM h),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first_id < doc_id),
    r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
    SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
        sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(gone, []), p)), lambda p: w[p]), ' ')) AS kept_sha256
    FROM t LEFT JOIN r USING (doc_id)"""
}
