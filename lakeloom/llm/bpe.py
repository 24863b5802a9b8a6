"""BPE encoding and decoding in batched numpy merge rounds.

All words of a chunk of texts are hashed at once; a word seen before by the worker takes its ids from
a bounded table. The symbols of all new words lie in one flat array. Each round looks up changed
neighbour pairs by binary search over the sorted pair keys, finds each word's lowest rank, and merges
that pair throughout the word; words without a mergeable pair leave the array. Merging all occurrences
at once gives the same ids as one at a time because no merge that uses a token ranks before the merge
that makes it; loading checks this.

Reads ``tokenizers`` files of the kind byte-level BPE with a word-end suffix: NFC, white space dropped,
lower case. Their special tokens are found in the raw text. Nothing is truncated or padded.

Cases: a null or empty text has no ids and decodes to an empty text; ids that the vocabulary lacks are
skipped in decoding; repeated rows and null keys pass as they are; other columns pass unchanged, except
that the output column of the operator replaces one of the same name; no rows give no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

NONE = np.int64(1 << 40)
KNOWN_WORDS = 500_000
CHUNK_BYTES = 1 << 20  # a worker holds about 60 bytes of arrays for each byte of a chunk
#: White_Space of Unicode, as fixed values.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)
_LOADED: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str) -> Encoder:
    """The encoder of a file, kept for the life of the worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = _byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right = (np.array([vocab[p[side]] for p in pairs], np.int64) for side in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank_of = dict(zip(self.made.tolist(), range(len(pairs)), strict=True))
        if len(rank_of) < len(pairs) or any(rank_of.get(t, -1) >= r for r, p in enumerate(zip(left.tolist(), right.tolist(), strict=True)) for t in p):
            raise ValueError(f"{path}: merges out of order")
        self.size = np.int64(size)
        keys = left * self.size + right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.mark = os.path.commonprefix(list(self.special))  # what every special token starts with
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            category = unicodedata.category(chr(c))[0]
            if category == "L":
                self.kind[c] = LETTER
            elif category == "N":
                self.kind[c] = NUMBER
        self.kind[SPACES] = SPACE
        self.code = flat._stream(0x110000, 47)
        self._forget()

    def _forget(self):
        self.hash, self.at, self.count = np.zeros(0, flat.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _rank(self, left, right):
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], NONE)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (UTF-8 bytes in a row, byte length of each), in a row, and the number of each."""
        n = len(lengths)
        end = np.zeros(len(data), bool)
        end[np.cumsum(lengths) - 1] = True
        symbol = np.where(end, self.last[data], self.first[data])
        word, lengths = np.arange(n), lengths.copy()
        rank = np.full(len(data), NONE)
        inner = np.flatnonzero(~end)
        rank[inner] = self._rank(symbol[inner], symbol[inner + 1])
        done_word, done_count, done_ids = [], [], []
        while len(word):
            starts = np.cumsum(lengths) - lengths
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():
                stay = np.repeat(live, lengths)
                done_word.append(word[~live])
                done_count.append(lengths[~live])
                done_ids.append(symbol[~stay])
                word, lengths, low = word[live], lengths[live], low[live]
                symbol, rank, end = symbol[stay], rank[stay], end[stay]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), lengths)
            at = np.flatnonzero(rank == low[owner])
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            if not new.all():  # in a run of overlapping pairs, every other one
                order = np.arange(len(at))
                at = at[(order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            end[at] = end[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            lengths = lengths - np.bincount(owner[at], minlength=len(word))
            symbol, rank, end = symbol[keep], rank[keep], end[keep]
            at = at - np.arange(len(at))
            before = at[at > 0] - 1
            redo = np.concatenate((at, before))
            rank[redo] = NONE
            redo = redo[~end[redo]]
            rank[redo] = self._rank(symbol[redo], symbol[redo + 1])
        if not done_word:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        word, count, ids = (np.concatenate(x) for x in (done_word, done_count, done_ids))
        total = np.empty(n, np.int64)
        total[word] = count
        source = np.empty(n, np.int64)
        source[word] = np.cumsum(count) - count
        return ids[spread(source, total)].astype(np.uint32), total

    def _words(self, points, offsets):
        """Start and end of each word among code points; offsets: where each text starts."""
        kind = self.kind[points]
        n = len(points)
        start = np.zeros(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start[:n] |= kind == NUMBER
        edge = np.zeros(n + 2, bool)
        edge[offsets] = True
        start |= edge[: n + 1]
        start[:n] &= kind != SPACE
        padded = np.concatenate((points, np.zeros(3, points.dtype)))
        mark = np.flatnonzero((points == 39) & start[:n])  # 's 't 'm 'd 're 've 'll, where a word would start
        if len(mark):
            mark = mark[~edge[mark + 1]]
            one, two = padded[mark + 1], padded[mark + 2]
            pair = ~edge[mark + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            mark, size = mark[a := np.isin(one, [ord(c) for c in "stmd"]) | pair], np.where(pair[a], 2, 1)
            start[mark + 1] = False
            after = mark + 1 + size
            cut = after[(after < n) & ~edge[np.minimum(after, n)]]
            start[cut[kind[cut] == LETTER]] = True
        space = np.append(kind == SPACE, True)
        last = np.flatnonzero((start[1:] | space[1:] | edge[1 : n + 1]) & ~space[:n]) + 1
        return np.flatnonzero(start[:n]), last

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and where each text's ids start; the last entry is their number."""
        units, unit_special, unit_of = [], [], [0]
        for text in texts:
            parts = self.cut.split(text) if text and self.cut and self.mark in text else (text,)
            for part in parts:
                special = self.special.get(part, -1) if len(parts) > 1 else -1
                part = "" if special >= 0 or not part else part
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                units.append(part.lower())
                unit_special.append(special)
            unit_of.append(len(units))
        offsets = np.cumsum([0, *map(len, units)])
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        starts, ends = self._words(points, offsets) if len(points) else (np.zeros(0, np.int64),) * 2
        ids, ends_at = self._ids(points, starts, ends)
        bounds = ends_at[np.searchsorted(starts, offsets)]
        special = np.array(unit_special)
        where = np.flatnonzero(special >= 0)
        if len(where):
            ids = np.insert(ids, bounds[where], special[where])
            bounds = bounds + np.concatenate(([0], np.cumsum(special >= 0)))
        return ids, bounds[unit_of]

    def _ids(self, points, starts, ends):
        """Ids of all words in a row; before each word, how many."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        hashes = flat.span_hash(points, starts, ends, self.code)
        order = np.argsort(hashes)
        first, times = flat.runs(hashes[order])
        unique = hashes[order[first]]
        slot = np.empty(len(hashes), np.int64)
        slot[order] = np.repeat(np.arange(len(first)), times)
        self._learn(points, starts, ends, order[first], unique)
        known = np.searchsorted(self.hash, unique)
        at, count = self.at[known][slot], self.count[known][slot]
        return self.pool[spread(at, count)], np.concatenate(([0], np.cumsum(count)))

    def _learn(self, points, starts, ends, example, unique):
        if len(self.hash) + len(unique) > KNOWN_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.hash, unique), max(len(self.hash) - 1, 0))
        new = self.hash[at] != unique if len(self.hash) else np.ones(len(unique), bool)
        if not new.any():
            return
        begin, size = starts[example[new]], (ends - starts)[example[new]]
        chars = points[spread(begin, size)]
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        data = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        ids, count = self.merge(data, np.add.reduceat(width, np.cumsum(size) - size).astype(np.int64))
        place = np.cumsum(count) - count + len(self.pool)
        self.pool = np.concatenate((self.pool, ids))
        hashes = np.concatenate((self.hash, unique[new]))
        order = np.argsort(hashes, kind="stable")
        self.hash, self.at, self.count = hashes[order], np.concatenate((self.at, place))[order], np.concatenate((self.count, count))[order]

    def decode(self, ids: np.ndarray) -> str:
        """The token strings of ``ids``, joined by spaces: such a file names no decoder."""
        tokens = self.tokens
        if len(ids) and int(ids.max()) >= len(tokens):
            ids = ids[ids < len(tokens)]
        return " ".join(map(tokens.__getitem__, ids.tolist()))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .. and so on."""
    shift = start - (np.cumsum(length) - length)
    return np.repeat(shift, length) + np.arange(int(length.sum()))


def text_chunks(column: pa.Array):
    """(first row, end row, list of texts) of slices of about ``CHUNK_BYTES``."""
    sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))))
    at, n = 0, len(column)
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK_BYTES, "right")) - 1))
        yield at, end, column.slice(at, end - at).to_pylist()
        at = end


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with column ``target`` made from column ``source`` by ``make(column)``, which yields (first, end, array)."""
    df = df.drop(target) if target in df.columns and target != source else df
    fields = [f for f in df.schema.fields if f.name != target]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for first, end, made in make(batch.column(source)):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), made], names=[*names, target])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(target, kind)]))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` with the ids of each text: array<int>, or little-endian unsigned 32-bit integers if ``packed``."""
    path = path or default_path()

    def make(column):
        encoder = load(path)
        for first, end, texts in text_chunks(column):
            numbers, bounds = encoder.encode(texts)
            if packed:
                yield first, end, pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(numbers.astype("<u4").tobytes())])
            else:
                yield first, end, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(numbers.astype(np.int32)))

    return _mapped(docs, text, ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids, given in either form of ``encode``."""
    path = path or default_path()
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)

    def make(column):
        encoder = load(path)
        for first in range(0, len(column), 500):
            part = column.slice(first, 500)
            if packed:
                arrays = (np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4") for x in part)
            else:
                arrays = (np.array([i for i in x or () if i is not None and i >= 0], np.int64) for x in part.to_pylist())
            yield first, first + len(part), pa.array([encoder.decode(x) for x in arrays], pa.string())

    return _mapped(df, ids, text, T.StringType(), make)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = decode(encode(docs, packed=True).select("doc_id", "ids"))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_bpe": op7_bpe}
