"""URL filtering: fixed host rules first, then association rules mined from labelled urls.

A url's host and path are cut natively. Fixed rules fit a host and its subdomains by path prefix; the
longest that fits decides. All other urls are judged by mined rules: FP-growth over the token sets of
labelled urls, with the label as one more item, gives combinations of tokens that go with bad pages. A rule stays if it has
``support``, at least ``least_rows`` labelled urls and at most ``most_tokens`` items, if bad pages are ``lift`` times as common under it as
among all labelled urls (its confidence, over the base rate) and by more than ``least_z`` standard errors, and if no
rule with fewer of its tokens is as confident. The rest are indexed by their rarest token: a url looks up its own tokens
and checks only the rules found there.

Tokens that the same labelled urls have are one item of the mining, so long paths that many urls share cost no
combinations of their own; a rule with such an item asks for all its tokens.

``labels`` name documents, and a page is the page of the document with its id: that id is the only link between the two tables.
Mining reads at most about ``fit_rows`` labelled urls, chosen by a hash of the id. Every url is judged. More than ``MOST_RULES`` pruned
rules are an error (raise ``support``): they are broadcast.

Cases: a null url, or one without ``://``, has empty host and path, no tokens and the verdict allow unless
a fixed rule fits; repeated rows are judged alike, and mined from once for each distinct id and url; null ids pass; null labels are not used; no labels
give no mined rules; no rows give no rows. Columns host, path, rule, verdict replace such columns, those with a
leading ``_ll_`` are dropped, others pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialise

FIT_ROWS = 50_000
MOST_RULES = 100_000
BAD = "!bad"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    cut = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, cut, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(url, cut, 2)})


def tokens(url):
    """Distinct lower-case tokens of a url, marked with the part they come from."""
    text = F.lower(F.coalesce(url, F.lit("")))
    cut = r"^(?s:.*?)://([^/?#]*)([^?#]*)(?s:(.*))"

    def part(group: int, mark: str):
        words = F.split(F.regexp_extract(text, cut, group), "[^\\p{L}\\p{N}]+")
        return F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit(mark), w))

    return F.array_distinct(F.concat(part(1, "h:"), part(2, "p:"), part(3, "q:")))


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    confidence: float
    support: float


def prune(rules: Iterable[Mined]) -> list[Mined]:
    """Rules that no rule with fewer of their tokens matches in confidence."""
    kept: list[Mined] = []
    by_token: dict[str, list[Mined]] = {}
    for rule in sorted(rules, key=lambda r: (len(r.tokens), -r.confidence, r.tokens)):
        mine = set(rule.tokens)
        if any(set(k.tokens) <= mine and k.confidence >= rule.confidence for t in mine for k in by_token.get(t, ())):
            continue
        kept.append(rule)
        for t in rule.tokens:
            by_token.setdefault(t, []).append(rule)
    return kept


def mine(pages: DataFrame, labels: DataFrame, support: float = 0.002, lift: float = 1.5, least_rows: int = 5, least_z: float = 2.0, most_tokens: int = 4, fit_rows: int = FIT_ROWS) -> tuple[list[Mined], dict[str, int]]:
    """Pruned rules for bad pages (labels: doc_id of the page, quality 0 is bad), and how many labelled urls hold each of their tokens."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_ll_id")).agg(F.min("quality").alias("quality"))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("_ll_id"), F.lit(1_000_003)) < share * 1_000_003)
    urls = pages.select(F.col("page_id").cast("long").alias("_ll_id"), "url").distinct()
    rows = materialise(urls.join(known, "_ll_id").select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("items"), (F.col("quality") == 0).alias("bad")).filter(F.size("items") > 0), "labelled")
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not bad or bad == n:
        return [], {}
    least = max(least_rows, support * n)
    each = rows.select("row", F.explode("items").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows")).filter(F.col("n") >= least)  # those of frequent tokens: at most the tokens of the rows over ``least``
    items = held.groupBy("n", "rows").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("tokens"))
    items = materialise(items.select("item", "tokens", "n"), "items")
    baskets = each.join(items.select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    own = F.coalesce("items", F.array().cast("array<string>"))
    baskets = rows.select("row", "bad").join(baskets, "row", "left").select(F.when(F.col("bad"), F.array_append(own, BAD)).otherwise(own).alias("items"))
    rate = bad / n
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=min(1.0, rate * lift)).fit(materialise(baskets, "baskets"))
    fires = F.round(F.col("support") * n / F.col("confidence"))
    surely = (F.col("confidence") - rate) * F.sqrt(fires) >= least_z * (rate * (1 - rate)) ** 0.5
    rules = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.size("antecedent") <= most_tokens) & surely)
    found = rules.select("antecedent", "confidence", "support").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; raise support")
    used = sorted({t for r in found for t in r.antecedent})
    of = {r.item: r for r in items.filter(F.col("item").isin(used)).collect()} if used else {}
    mined = prune(Mined(tuple(sorted(t for item in r.antecedent for t in of[item].tokens)), r.confidence, r.support) for r in found)
    return mined, {t: of[item].n for item in of for t in of[item].tokens}


def held_out(pages: DataFrame, labels: DataFrame, **options) -> dict[str, float]:
    """Precision, recall and base rate of mined rules on labelled urls whose crc32(id as text) mod 4 is 2, mined from the others."""
    kept = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    rules, counts = mine(pages, labels.filter(~kept), **options)
    judged = judge(pages.select("page_id", "url"), rules, counts, ()).join(labels.filter(kept & F.col("quality").isNotNull()).select(F.col("doc_id").alias("page_id"), "quality"), "page_id")
    bad, blocked = F.col("quality") == 0, F.col("verdict") == "block"
    r = judged.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(blocked).alias("blocked"), F.count_if(bad & blocked).alias("both")).first()
    return {"rules": len(rules), "rows": r.n, "base": r.bad / max(r.n, 1), "blocked": r.blocked, "precision": r.both / max(r.blocked, 1), "recall": r.both / max(r.bad, 1)}


def judge(pages: DataFrame, mined: list[Mined], counts: dict[str, int] | None = None, rules: tuple[HostRule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    pages = with_parts(pages.drop("host", "path", "rule", "verdict", *[c for c in pages.columns if c.startswith("_ll_")]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    pages = pages.withColumns({"rule": rule, "_ll_fixed": verdict, "_ll_tokens": F.when(verdict.isNull(), tokens(F.col("url")))})
    index: dict[str, list[frozenset[str]]] = {}
    for r in mined:
        rarest = min(r.tokens, key=lambda t: ((counts or {}).get(t, 0), t))
        index.setdefault(rarest, []).append(frozenset(r.tokens))
    shared = pages.sparkSession.sparkContext.broadcast(index)  # as large as the pruned rules
    names = [c for c in pages.columns if not c.startswith("_ll_")]
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("verdict", T.StringType())])

    def run(batches):
        by_token = shared.value
        for batch in batches:
            out = []
            for fixed, own in zip(batch.column("_ll_fixed").to_pylist(), batch.column("_ll_tokens").to_pylist(), strict=True):
                if fixed is None:
                    have = set(own or ())
                    fixed = "block" if any(r <= have for t in have for r in by_token.get(t, ())) else "allow"
                out.append(fixed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "verdict"])

    return pages.mapInArrow(run, schema)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("pages", "labels"))
    urls = pages.select("page_id", "url")
    return judge(urls, *mine(urls, labels)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filter": op1_url_filter}
