"""Places of regular expressions as column expressions, without Python on the executors.

Work is linear in the text and nearly so in the number of matches: running totals are made chunk by chunk, and parts of
a text are read from pieces of it, never from its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"
CHUNK = 256
PIECE = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _larger(a, b):
    return F.greatest(a, b)


def running(values: Column, join) -> Column:
    """Running results of ``join`` (sum or maximum, from 0) over an array of longs."""
    zero = F.lit(0).cast("long")

    def extend(done, x):
        return F.concat(done, F.array(join(F.element_at(done, -1), x)))

    def whole(chunks):
        bases = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, zero, join)), F.array(zero), extend)
        return F.flatten(F.zip_with(chunks, F.slice(bases, F.lit(1), F.size(chunks)), lambda c, b: F.slice(F.aggregate(c, F.array(b), extend), 2, CHUNK)))

    def cut(v):
        last = F.greatest(F.ceil(F.size(v) / CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))

    return let(values, lambda v: let(cut(v), whole))


def find(text: Column, kind: str, pattern: str, hint: str, keep=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (kind, start, end, value), in code points, end exclusive.

    ``hint``: a cheap pattern that every text with a match matches. ``keep``: condition on group
    ``group`` of a match; failing matches are dropped, not tried again. The pieces between the matches
    come from ``split``, the matches from ``regexp_extract_all``; places are running sums of lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    steps = F.filter(F.arrays_zip(F.transform(between, F.length).alias("gap"), whole.alias("m"), part.alias("g")), lambda x: x["m"].isNotNull())

    def placed(s):
        ends = running(F.transform(s, lambda x: (x["gap"] + F.length(x["m"])).cast("long")), lambda a, b: a + b)
        every = F.zip_with(s, ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("m"), x["g"].alias("g")))
        kept = every if keep is None else F.filter(every, lambda x: keep(x["g"]))
        return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("value")))

    return F.when(text.rlike(hint), let(steps, placed)).otherwise(F.array().cast(SPAN))


def pieces(text: Column) -> Column:
    """``text`` cut into pieces of ``PIECE`` code points, for ``between``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text given in pieces."""
    first = F.floor(start / PIECE).cast("int")
    many = F.when(end > start, F.floor((end - 1) / PIECE).cast("int") - first + 1).otherwise(0)
    return F.substr(F.array_join(F.slice(cut, first + 1, many), ""), (start % PIECE + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with [kind] in place of each of ``spans`` (by start); of spans that overlap, the first names them all."""

    def build(cut):
        def joined(s):
            def done(ends):
                before = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size(ends) - 1))
                parts = F.zip_with(s, before, lambda x, at: F.when(x["start"] >= at, F.concat(between(cut, at, x["start"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(""))
                return F.concat(F.array_join(parts, ""), between(cut, F.element_at(ends, -1), F.length(text).cast("long")))

            return let(running(F.transform(s, lambda x: x["end"]), _larger), done)

        return let(spans, joined)

    return F.when(F.size(spans) > 0, let(pieces(text), build)).otherwise(text)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``."""
    far = 1 << 62
    mine = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("mine"), x["end"].alias("end"), x.alias("x")))
    theirs = F.transform(others, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("mine"), x["end"].alias("end"), x.alias("x")))

    def judged(every):
        ends = running(F.transform(every, lambda x: F.when(x["mine"] == 0, x["end"]).otherwise(F.lit(0).cast("long"))), _larger)
        starts = running(F.transform(F.reverse(every), lambda x: F.when(x["mine"] == 0, F.lit(far) - x["start"]).otherwise(F.lit(0).cast("long"))), _larger)
        both = F.arrays_zip(every.alias("s"), ends.alias("e"), F.reverse(starts).alias("n"))
        free = F.filter(both, lambda x: (x["s"]["mine"] == 1) & (x["e"] <= x["s"]["start"]) & (F.lit(far) - x["n"] >= x["s"]["end"]))
        return F.transform(free, lambda x: x["s"]["x"])

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(F.array_sort(F.concat(mine, theirs)), judged)).otherwise(spans)


def ordered(spans: Column, kinds: list[str], by_start: bool) -> Column:
    """``spans`` sorted by (start, kind as listed) or (kind as listed, start)."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])

    def key(x):
        order = [x["start"].alias("a"), place[x["kind"]].alias("b")]
        return F.struct(*(order if by_start else order[::-1]), x["end"].alias("e"), x.alias("x"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: x["x"])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
