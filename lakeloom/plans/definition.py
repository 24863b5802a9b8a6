"""Reading, checking and running definitions.

A definition has ``sources`` (by name), ``steps`` (operations in order; each reads the result before it, or
those it names) and an ``output``. ``plan`` turns it into one DataFrame; nothing runs before the write.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import quality, sinks
from ..expr.parser import ExpressionError, parse
from ..operators import facts, joins, project, reshape, rows
from ..sources import files, http, windows


class DefinitionError(ValueError):
    def __init__(self, problems: Sequence[tuple[str, str, str]]):
        super().__init__("; ".join(f"{code} at {where}: {text}" for code, where, text in problems))
        self.problems = list(problems)


def _filter(df, p, frames):
    if "thin" in p:
        return project.filter_thin(df, p["thin"])
    return project.filter_sql(df, p["sql"]) if "sql" in p else project.filter_expression(df, p["expression"], p.get("order", ()))


def _join(df, p, frames):
    options = {k: p[k] for k in ("suffix", "include", "exclude", "regex", "exclude_regex") if k in p}
    return joins.join(df, frames[p["right"]], p.get("keys", ()), p.get("how", "left"), **options)


def _assert(df, p, frames):
    return df  # a run checks the rules at their place, see ``run``


#: name: (needed parameters, function of frame, parameters and all frames)
OPERATIONS = {
    "filter": ((), _filter),
    "include_columns": (("columns",), lambda df, p, f: project.include_columns(df, p["columns"])),
    "exclude_columns": (("columns",), lambda df, p, f: project.exclude_columns(df, p["columns"])),
    "rename_columns": ((), lambda df, p, f: project.rename_columns(df, p.get("mapping"), p.get("rules", ()), p.get("unmatched", "ignore"))),
    "project": (("fields",), lambda df, p, f: project.project(df, p["fields"])),
    "type_cast": (("casts",), lambda df, p, f: project.type_cast(df, p["casts"])),
    "grouped_cast": (("groups",), lambda df, p, f: project.grouped_cast(df, p["groups"], p.get("default", "string"))),
    "add_calc": (("expressions",), lambda df, p, f: project.add_calc(df, p["expressions"], p.get("order", ()))),
    "reference_replace": (("column", "lookup", "old", "new"), lambda df, p, f: project.reference_replace(df, p["column"], f[p["lookup"]], p["old"], p["new"])),
    "active_row_selection": ((), lambda df, p, f: df if p.get("mode") == "all_rows" else rows.sort_first(df, p["group"], p.get("sort", ()), p.get("ties", ()))),
    "list_restore": (("lookup", "group", "values", "coords", "order"), lambda df, p, f: reshape.restore_lists(df, f[p["lookup"]], p["group"], p["values"], p["coords"], p["order"], p.get("lookup_coords"))),
    "expand_list_rows": ((), lambda df, p, f: reshape.expand_lists(df, p.get("columns"), position=p.get("position"))),
    "compact_list_rows": (("parents", "key", "columns", "position"), lambda df, p, f: reshape.compact_lists(df, f[p["parents"]], p["key"], p["columns"], p["position"])),
    "unnest": ((), lambda df, p, f: reshape.unnest(df, p.get("columns"), p.get("max_elements_per_row", 1024))),
    "unpivot": (("ids",), lambda df, p, f: reshape.unpivot(df, p["ids"], p["columns"], p.get("name", "name"), p.get("value", "value"), p.get("coercion"), p.get("preserve_nulls", True)) if "columns" in p else reshape.unpivot_remaining(df, p["ids"], p.get("value_type", "string"), p.get("name", "name"), p.get("value", "value"))),
    "pivot": (("row_keys", "column_keys", "values", "order"), lambda df, p, f: reshape.pivot(df, **{k: v for k, v in p.items() if k not in ("op", "input")})),
    "long_fact": (("identity", "facts"), lambda df, p, f: reshape.long_fact(df, p["identity"], p["facts"], p.get("generation", ""))),
    "join": (("right",), _join),
    "enrich": (("lookup", "keys", "columns"), lambda df, p, f: joins.enrich(df, f[p["lookup"]], p["keys"], p["columns"])),
    "union_rows": (("members", "identity"), lambda df, p, f: joins.union_rows({m: f[m] for m in p["members"]}, p["identity"])),
    "define_keyspace": (("members", "keys"), lambda df, p, f: joins.keyspace([f[m] for m in p["members"]], p["keys"], p.get("nulls", "error"))),
    "column_alias": (("names", "registry"), lambda df, p, f: project.rename_columns(df, {c: n for n, c in project.resolve_aliases(p["names"], df.columns, p["registry"]).items() if c != n})),
    "calculated_fact": (("expressions",), lambda df, p, f: facts.calculated_fact(df, p["expressions"], {a: {"frame": f[x["lookup"]], "keys": x["keys"]} for a, x in p.get("lookups", {}).items()}, p.get("aliases", {}), p.get("order", ()))),
    "multi_join": (("joins",), lambda df, p, f: joins.multi_join(df, [j | {"right": f[j["right"]]} for j in p["joins"]])),
    "preview": ((), lambda df, p, f: rows.preview(df, p.get("rows", 20))),
    "data_assertion": (("rules",), _assert),
}


def load(source: str | Mapping) -> dict:
    """A definition from a mapping, JSON or YAML text, or a file of either."""
    if isinstance(source, Mapping):
        return dict(source)
    text = Path(source).read_text() if source.endswith((".yaml", ".yml", ".json")) else source
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def _texts(step: Mapping):
    if step["op"] == "filter" and "expression" in step:
        yield step["expression"]
    if step["op"] in ("add_calc", "calculated_fact"):
        yield from step.get("expressions", {}).values()


def validate(document: Mapping) -> list[tuple[str, str, str]]:
    """Problems as (code, where, text); empty if the document can be planned."""
    out = []
    sources, steps = document.get("sources"), document.get("steps", [])
    if not isinstance(sources, Mapping) or not sources:
        out.append(("E_SOURCES", "sources", "a definition needs sources"))
    known = set(sources or ())
    for i, step in enumerate(steps):
        where = f"steps[{i}]"
        if step.get("op") not in OPERATIONS:
            out.append(("E_OPERATION", where, f"unknown operation {step.get('op')!r}"))
            continue
        needed, _ = OPERATIONS[step["op"]]
        out += [("E_PARAMETER", where, f"{step['op']} needs {n}") for n in needed if n not in step]
        if step["op"] == "filter" and sum(k in step for k in ("sql", "expression", "thin")) != 1:
            out.append(("E_PARAMETER", where, "a filter has one of sql, expression and thin"))
        names = [step[k] for k in ("input", "right", "lookup", "parents") if k in step] + list(step.get("members", ()))
        names += [x.get("lookup") for x in step.get("lookups", {}).values()] + [x.get("right") for x in step.get("joins", ())]
        out += [("E_REFERENCE", where, f"unknown frame {n!r}") for n in names if n not in known]
        for text in _texts(step):
            try:
                parse(text)
            except ExpressionError as error:
                out.append(("E_EXPRESSION", where, str(error)))
        if "as" in step:
            known.add(step["as"])
    output = document.get("output", {})
    if output and "path" not in output:
        out.append(("E_OUTPUT", "output", "an output needs a path"))
    return out


def read_source(spark: SparkSession, source: Mapping, outputs: Mapping[str, str]) -> DataFrame:
    if "csv" in source:
        return files.read_csv(spark, **source["csv"])
    if "windows" in source:
        return windows.read_windows(spark, source["windows"])
    if "http" in source:
        return http.read_source(spark, source["http"])
    if "sql" in source:
        return spark.sql(source["sql"], args=source.get("parameters", {}))
    paths = source.get("paths") or files.resolve(spark, source, outputs)
    if "catalog" in source:
        paths = files.select_labels(source["catalog"], source.get("labels", {}))
    return files.read_parquet_union(spark, paths)


def _frames(spark: SparkSession, document: Mapping, outputs, frames) -> tuple[DataFrame, list[tuple[DataFrame, list]]]:
    """The result, and each assertion's frame and rules."""
    known = {name: (frames or {}).get(name) or read_source(spark, s, outputs or {}) for name, s in document["sources"].items()}
    df, asserted = next(iter(known.values())), []
    for step in document.get("steps", []):
        before = known[step["input"]] if "input" in step else df
        df = OPERATIONS[step["op"]][1](before, step, known)
        if step["op"] == "data_assertion":
            asserted.append((df, list(step["rules"])))
        if "as" in step:
            known[step["as"]] = df
    return df, asserted


def plan(spark: SparkSession, document: str | Mapping, outputs: Mapping[str, str] | None = None, frames: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The definition as one lazy DataFrame. ``frames`` stand in for sources of the same name."""
    document = load(document)
    if problems := validate(document):
        raise DefinitionError(problems)
    return _frames(spark, document, outputs, frames)[0]


def run(spark: SparkSession, document: str | Mapping, outputs: Mapping[str, str] | None = None, smoke: int | None = None) -> dict:
    """Plans, checks the assertions, and commits; an assertion that fails leaves the old dataset. ``smoke``: a trial run that writes so many rows at most.

    Rules see the rows at their step. Those of the result itself are checked on the staged files, so the plan runs once and what
    is checked is what is committed; those of an earlier step are checked on its frame before anything is written.
    """
    document = load(document)
    if problems := validate(document):
        raise DefinitionError(problems)
    df, asserted = _frames(spark, document, outputs, None)
    output, last = document["output"], []
    for frame, rules in asserted:
        if frame is df:
            last += rules
        else:
            quality.check(frame, rules)
    check = (lambda staged: quality.check(staged, last)) if last else None
    df = df.limit(smoke) if smoke is not None else df
    return sinks.commit(df, output["path"], output.get("partition"), output.get("rows_per_file", 0), output.get("order", ()), check)


def capabilities() -> dict:
    """What definitions can ask for."""
    from ..functions import scalar, windows

    return {
        "operations": sorted(OPERATIONS),
        "scalar_functions": sorted({*scalar.SCALARS, "if", "cast", "rand", "randbetween"}),
        "window_functions": sorted(windows.NAMES),
        "unsupported_functions": sorted(scalar.UNSUPPORTED),
        "joins": sorted(joins.HOW),
        "aggregates": list(reshape.AGGREGATES),
        "assertions": ["required_columns", "dtype", *quality.ROW_RULES, "unique", "row_count"],
    }
