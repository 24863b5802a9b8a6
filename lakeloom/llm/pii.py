"""Personal data by weak supervision.

Base rules find e-mail addresses, IPv4 addresses, payment cards and international telephone numbers;
what they find always stays. Looser patterns propose further candidates: national telephone and identity
numbers and bank accounts. Six labelers vote yes, no or nothing on every candidate, base spans
included: format rules, a gazetteer of words before the span, the characters on either side, the variety of its
digits, and words that speak against it. Expectation-maximisation over the counts of vote patterns (at most
3^6, whatever the corpus) estimates each labeler's reliability without labels. The posteriors then train a
naive Bayes span classifier on the spans' features, and candidates that it accepts are added, unless a
base span overlaps them.

Everything runs as DataFrame functions; the driver sees pattern and feature counts only.

Cases: a null or empty text has no spans; repeated rows each get their spans; null keys are kept; no
candidates leave the base spans alone; no rows give no rows. The result has the input's columns plus
``pii`` (array of kind, start, end, value by kind as listed, then start), which replaces a column of that
name; columns with a leading ``_ll_`` are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .store import materialise

LOCAL = "A-Za-z0-9._%+-"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = ["email", "ip", "card", "phone"]
ADDED = ["local_phone", "identity", "account"]
KINDS = BASE + ADDED
ACCEPT = 0.8
ROUNDS = 60
#: Words that go with personal data, and words that go with other numbers (fixed values).
FOR = "tel|phone|fon|call|mobil|cell|fax|contact|kontakt|mail|correo|courriel|ssn|social|iban|konto|cuenta|compte|account|card|karte|tarjeta|carte|passport|address|adresse"
AGAINST = "version|price|preis|prix|precio|order|isbn|issn|total|page|seite|doi|sku|model|serial"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def base_spans(text: Column) -> Column:
    """The spans of the four base rules. Patterns start only where a run of their characters starts, or where
    the last match ended, and never give back characters: the same matches, in time linear in the text."""
    email = spans.find(text, "email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@")
    ip = spans.find(text, "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", lambda m: m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
    card = spans.find(text, "card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", _card)
    phone = spans.find(text, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m)).between(9, 15))
    return F.concat(email, ip, card, phone)


def loose_spans(text: Column) -> Column:
    """Candidates of the looser patterns."""
    alone, end = r"(?<![0-9A-Za-z+.-])", r"(?![0-9A-Za-z-])"
    return F.concat(
        spans.find(text, "local_phone", rf"{alone}(?:\([0-9]{{3}}\)\x20?|[0-9]{{3}}[-.\x20])[0-9]{{3}}[-.\x20][0-9]{{4}}{end}", r"[0-9]{3}[-.\x20][0-9]{4}"),
        spans.find(text, "identity", rf"{alone}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{end}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        spans.find(text, "account", rf"{alone}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}}{end}", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    )


def _with_context(text: Column, found: Column) -> Column:
    def every(cut):
        def add(x):
            left = F.lower(spans.between(cut, F.greatest(x["start"] - 40, F.lit(0)), x["start"]))
            return F.struct(x["kind"], x["start"], x["end"], x["value"], left.alias("left"), spans.between(cut, x["end"], x["end"] + 1).alias("right"))

        return F.transform(found, add)

    return spans.let(F.when(F.size(found) > 0, spans.pieces(text)).otherwise(F.array().cast("array<string>")), every)


def _votes() -> dict[str, Column]:
    """0 no, 1 yes, 2 nothing."""
    before, after = F.substr(F.col("left"), F.greatest(F.length("left"), F.lit(1)), F.lit(1)), F.col("right")
    digits = _digits(F.col("value"))
    variety = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda i: F.substr(digits, i, F.lit(1)))))
    return {
        "format": F.when(F.col("kind").isin(BASE), 1).when(F.col("kind") == "account", F.when(F.length(F.regexp_replace("value", " ", "")).between(15, 34), 1).otherwise(0)).otherwise(2),
        "gazetteer": F.when(F.col("left").rlike(rf"(?:{FOR})[^0-9]{{0,20}}$"), 1).otherwise(2),
        "left": F.when(before.rlike(r"^[\s:(\[<\"'=,;]?$"), 1).otherwise(0),
        "right": F.when(after.rlike(r"^[\s.,;:)\]>\"'!?]?$"), 1).otherwise(0),
        "variety": F.when(F.col("kind") == "email", 2).when(variety >= 4, 1).otherwise(0),
        "against": F.when(F.col("left").rlike(rf"(?:{AGAINST}|[$€£#])[^0-9]{{0,12}}$"), 0).otherwise(2),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Prior log odds, and each labeler's log odds of each vote, by expectation-maximisation over vote counts."""
    if not patterns:
        return 0.0, []
    k = len(next(iter(patterns)))
    post = {}
    for votes in patterns:
        yes, no = sum(v == 1 for v in votes), sum(v == 0 for v in votes)
        post[votes] = (yes + 1) / (yes + no + 2)
    prior, tables = 0.0, []
    for _ in range(rounds):
        mass = [1.0 + sum(n * (1 - post[v]) for v, n in patterns.items()), 1.0 + sum(n * post[v] for v, n in patterns.items())]
        prior, tables = math.log(mass[1] / mass[0]), []
        for i in range(k):
            odds = {}
            for vote in (0, 1, 2):
                p = [1.0, 1.0]  # a labeler starts as slightly better than chance
                if vote < 2:
                    p[vote] += 1.0
                for votes, n in patterns.items():
                    if votes[i] == vote:
                        p[1] += n * post[votes]
                        p[0] += n * (1 - post[votes])
                odds[vote] = math.log(p[1] / (mass[1] + 3)) - math.log(p[0] / (mass[0] + 3))
            tables.append(odds)
        post = {v: 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(t[x] for t, x in zip(tables, v, strict=True)))))) for v in patterns}
    return prior, tables


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def _by_value(column: Column, odds: dict) -> Column:
    out = F.lit(0.0)
    for value, weight in odds.items():
        out = F.when(column == value, F.lit(float(weight))).otherwise(out)
    return out


def _features() -> dict[str, Column]:
    return {
        "size": F.floor(F.length("value") / 4).cast("string"),
        "separators": F.least(F.length(F.regexp_replace("value", "[0-9A-Za-z]", "")), F.lit(5)).cast("string"),
        **{f"vote_{name}": F.col(name).cast("string") for name in ("gazetteer", "left", "right", "variety", "against")},
    }


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: the base spans, and the candidates that the trained classifier accepts."""
    docs = docs.drop("pii", *[c for c in docs.columns if c.startswith("_ll_")])
    text = F.coalesce("text", F.lit(""))
    staged = docs.withColumn("_ll_row", F.monotonically_increasing_id()).withColumn("_ll_base", base_spans(text)).withColumn("_ll_loose", F.when(text.rlike("[0-9]{2}"), loose_spans(text)).otherwise(F.array().cast(spans.SPAN)))
    apart = spans.apart(F.col("_ll_loose"), F.col("_ll_base"))
    staged = staged.withColumn("_ll_all", F.concat("_ll_base", apart)).withColumn("_ll_seen", _with_context(text, F.col("_ll_all"))).drop("_ll_loose", "_ll_all")
    staged = materialise(staged, "pii")
    seen = staged.filter(F.size("_ll_seen") > 0).select("_ll_row", F.explode("_ll_seen").alias("x")).select("_ll_row", "x.*")
    votes = _votes()
    voted = materialise(seen.withColumns(votes), "votes")
    names = list(votes)
    patterns = {tuple(r[n] for n in names): r.n for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    prior, tables = estimate(patterns)
    if tables:
        odds = F.lit(float(prior))
        for name, table in zip(names, tables, strict=True):
            odds = odds + _by_value(F.col(name), table)
        weighted = voted.withColumn("p", _sigmoid(odds))
        features = _features()
        pairs = weighted.select("p", F.explode(F.array(*[F.concat_ws("=", F.lit(n), c) for n, c in features.items()])).alias("feature"))
        learned = {r.feature: (r.yes, r.no) for r in pairs.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
        total = weighted.agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).first()
        final = F.lit(math.log((total.yes + 1) / (total.no + 1)))
        for name, column in features.items():
            values = {f.split("=", 1)[1]: math.log((y + 0.5) / (total.yes + 1)) - math.log((n + 0.5) / (total.no + 1)) for f, (y, n) in learned.items() if f.startswith(name + "=")}
            final = final + _by_value(column, values)
        taken = voted.filter(~F.col("kind").isin(BASE)).filter(_sigmoid(final) >= ACCEPT)
        extra = taken.groupBy("_ll_row").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("_ll_more"))  # those of one text
        staged = staged.join(extra, "_ll_row", "left")
        found = F.concat("_ll_base", F.coalesce("_ll_more", F.array().cast(spans.SPAN)))
    else:
        found = F.col("_ll_base")
    return staged.withColumn("pii", spans.ordered(found, KINDS, False)).drop("_ll_row", "_ll_base", "_ll_seen", "_ll_more")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    base = F.filter("pii", lambda x: x["kind"].isin(BASE))
    return found.select("doc_id", *[spans.count(F.col("pii"), k).alias(f"n_{k}") for k in BASE], F.sha2(spans.written(base), 256).alias("base_sha256"), spans.written(F.col("pii")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
