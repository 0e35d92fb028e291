"""Linking tool calls and results for chat training data.

Calls and results of a conversation are joined by (conversation, identifier), a key of few
rows even where one conversation holds a third of all rows.  Calls are put in an order in
which each follows the calls it builds on: by position where no call builds on a later one,
and else, in the conversations concerned, by rounds that settle the calls whose
predecessors are settled.  Arguments are checked against the tool's schema and everything
is written as canonical JSON (sorted keys, no spaces, one form for every number).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.session import written

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: What ``violations`` knows, and keywords that forbid nothing.
KEYWORDS = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minLength", "maxLength",
            "minimum", "maximum"}
NOTES = {"title", "description", "default", "examples"}


def known_schema(schema: dict, at: str) -> None:
    """ValueError where a schema asks for what is not checked here (nothing is passed over in silence)."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object")
    if odd := sorted(set(schema) - KEYWORDS - NOTES):
        raise ValueError(f"{at}: keywords not supported: {', '.join(odd)}")
    kinds = schema.get("type", [])
    if odd := sorted({kinds} if isinstance(kinds, str) else set(kinds)):
        if odd := [k for k in odd if k not in _TYPES and k not in ("integer", "number")]:
            raise ValueError(f"{at}: types not supported: {', '.join(odd)}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties is true or false here")
    for name, inner in schema.get("properties", {}).items():
        known_schema(inner, f"{at}.{name}")
    if "items" in schema:
        known_schema(schema["items"], f"{at}[]")


def _is_type(value, name: str) -> bool:
    if name == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if name == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[name])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` the schema forbids (type, enum, const, required, properties,
    additionalProperties, items, minLength, maxLength, minimum, maximum)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is_type(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    listed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if listed is not None and canonical(value) not in map(canonical, listed):
        out.append(f"{at}: not one of the listed values")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{at}: length {len(value)}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            out.append(f"{at}: out of range")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            out += violations(x, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not known")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _one_form(x):
    if isinstance(x, float) and x.is_integer() and abs(x) < 2 ** 53:
        return int(x)
    if isinstance(x, dict):
        return {k: _one_form(v) for k, v in x.items()}
    return [_one_form(v) for v in x] if isinstance(x, list) else x


def _escaped(text: str) -> str:
    """``text`` with lone surrogates as escapes: UTF-8 has no form for them."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return _escaped(json.dumps(_one_form(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def message(call_id, name, arguments, content, after, schemas: dict) -> tuple[str, list[str]]:
    """Canonical JSON of a linked call, and what is wrong with its arguments."""
    wrong, parsed = [], None
    if name is None:
        wrong.append("no call")
    elif name not in schemas:
        wrong.append("unknown tool")
    if arguments is not None:
        try:
            parsed = json.loads(arguments, parse_constant=_no_constant)
            canonical(parsed)
        except (ValueError, RecursionError):
            parsed = arguments
            wrong.append("arguments are no JSON")
        else:
            wrong += violations(parsed, schemas.get(name, {}))
    elif name is not None:
        wrong.append("no arguments")
    body = {"id": call_id, "name": name, "arguments": parsed, "after": sorted(after), "result": content}
    return canonical(body), [_escaped(w) for w in wrong]


def first_of(df: DataFrame, name: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """One row for each (conv, call_id), the first by position, and how many there were; and the other rows.

    Rows are numbered in a written table and the others found by their numbers, so that an
    identifier may have any share of the rows."""
    rows = written(df.select("conv", "call_id", *columns, F.monotonically_increasing_id().alias("row")), f"{name}-rows")
    first = written(rows.groupBy("conv", "call_id").agg(F.min(F.struct(*columns, "row")).alias("r"),
                                                        F.count(F.lit(1)).alias("copies"))
                    .select("conv", "call_id", "r.*", "copies"), name)
    if first.where("copies > 1").isEmpty():
        return first.drop("row"), rows.limit(0).drop("row")
    return first.drop("row"), rows.join(first.select("row"), "row", "left_anti").drop("row")


def depths(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call_id, depth) of the calls of conversations in which some call builds on a later
    one: the longest chain of calls below it, null on and above a cycle.

    ``calls``: conv, call_id, at; ``edges``: conv, call_id, dep, later.  One round a step of the
    longest chain."""
    hard = edges.where("later").select("conv").distinct()
    left = written(calls.join(hard, "conv", "left_semi").select("conv", "call_id"), "calls-left")
    open_edges = written(edges.join(hard, "conv", "left_semi").select("conv", "call_id", "dep"), "calls-edges")
    settled, depth = [], 0
    while not left.isEmpty():
        blocked = open_edges.select("conv", "call_id").distinct()
        free = written(left.join(blocked, ["conv", "call_id"], "left_anti"), "calls-free")
        if free.isEmpty():
            break
        settled.append(free.withColumn("depth", F.lit(depth)))
        depth += 1
        left = written(left.join(free, ["conv", "call_id"], "left_anti"), "calls-left")
        open_edges = written(open_edges.join(free.withColumnRenamed("call_id", "dep"), ["conv", "dep"], "left_anti"),
                             "calls-edges")
    out = left.withColumn("depth", F.lit(None).cast("int"))
    for s in settled:
        out = out.unionByName(s)
    return written(out, "calls-depth")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv, call_id, depth, at, status, calls, results, valid, errors, json), a row for each
    identifier of a conversation and for each repeated call or result.

    ``calls``: conv, call_id, at, name, arguments (JSON text), after (identifiers of calls built
    on); ``results``: conv, call_id, at, content.  Sorted by (depth, at, call_id), every call of
    a conversation follows those it builds on.  status: linked, no result, no call, result
    first (it stands before its call) or cycle (depth null).  Of several rows of one identifier
    the first by position is linked; ``calls`` and ``results`` tell how many there were, and each
    further one is a row of its own, repeated call or repeated result (depth null, not valid).  Null
    identifiers count as ''; null conversations are one conversation; calls that build on
    unknown calls are not valid; a schema with a keyword that is not checked is a ValueError;
    lone surrogates are written as escapes; empty tables give an empty result.
    """
    for tool, schema in schemas.items():
        known_schema(schema, tool)

    def keyed(df):
        return df.withColumn("call_id", F.coalesce(F.col("call_id").cast("string"), F.lit("")))

    c, more_calls = first_of(keyed(calls).withColumn("after", F.coalesce("after", F.array().cast("array<string>"))),
                             "calls", "at", "name", "arguments", "after")
    c = c.withColumnRenamed("copies", "calls")
    r, more_results = first_of(keyed(results), "results", "at", "content")
    r = r.select(
        F.col("conv").alias("rconv"), F.col("call_id").alias("rid"), F.col("at").alias("rat"), "content",
        F.col("copies").alias("results"))
    deps = c.select("conv", "call_id", "at", F.explode(F.array_distinct("after")).alias("dep"))
    known = c.select(F.col("conv").alias("dconv"), F.col("call_id").alias("did"), F.col("at").alias("dat"))
    edges = written(deps.join(known, F.col("conv").eqNullSafe(F.col("dconv")) & (F.col("dep") == F.col("did")), "left")
                    .select("conv", "call_id", "dep", F.col("did").isNull().alias("unknown"),
                            ((F.col("dat") > F.col("at")) | (F.col("dat") == F.col("at")) & (F.col("did") >= F.col("call_id")))
                            .alias("later")), "calls-deps")
    missing = (edges.where("unknown").groupBy("conv", "call_id").agg(F.sort_array(F.collect_set("dep")).alias("lost"))
               .select(F.col("conv").alias("lconv"), F.col("call_id").alias("lid"), "lost"))
    both = c.join(r, F.col("conv").eqNullSafe(F.col("rconv")) & (F.col("call_id") == F.col("rid")), "full")
    both = both.withColumn("conv", F.coalesce("conv", "rconv")).withColumn("call_id", F.coalesce("call_id", "rid"))
    both = both.join(missing, F.col("conv").eqNullSafe(F.col("lconv")) & (F.col("call_id") == F.col("lid")), "left")
    known_edges = edges.where("not unknown")
    if known_edges.where("later").isEmpty():
        both = both.withColumn("depth", F.lit(0)).withColumn("cycle", F.lit(False))
    else:
        # A null conversation takes part under a text of its own.
        name = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit(""))
        d = depths(c.withColumn("conv", name), known_edges.withColumn("conv", name)).select(
            F.col("conv").alias("zconv"), F.col("call_id").alias("zid"), F.col("depth").alias("zdepth"))
        both = both.join(d, (name == F.col("zconv")) & (F.col("call_id") == F.col("zid")), "left")
        both = (both.withColumn("cycle", F.col("zid").isNotNull() & F.col("zdepth").isNull())
                .withColumn("depth", F.when(~F.col("cycle"), F.coalesce("zdepth", F.lit(0)))))

    both = both.withColumn("repeated", F.lit(None).cast("string")).unionByName(
        more_calls.withColumn("repeated", F.lit("repeated call")).withColumn("calls", F.lit(1)), allowMissingColumns=True).unionByName(
        more_results.withColumnRenamed("at", "rat").withColumn("repeated", F.lit("repeated result")).withColumn("results", F.lit(1)),
        allowMissingColumns=True)

    @F.pandas_udf("json string, errors array<string>")
    def serialised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [message(i, n, a, t, d if d is not None else [], schemas)
                    for i, n, a, t, d in zip(b["call_id"], b["name"], b["arguments"], b["content"], b["after"])]
            yield pd.DataFrame({"json": [x[0] for x in rows], "errors": [x[1] for x in rows]})

    fields = F.struct("call_id", "name", "arguments", "content", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    status = (F.when(F.col("repeated").isNotNull(), F.col("repeated")).when(F.col("cycle"), "cycle").when(F.col("calls").isNull(), "no call")
              .when(F.col("results").isNull(), "no result").when(F.col("rat") <= F.col("at"), "result first")
              .otherwise("linked"))
    lost = F.transform(F.coalesce("lost", F.array().cast("array<string>")), lambda x: F.concat(F.lit("unknown call "), x))
    out = both.withColumn("s", serialised(fields)).withColumn(
        "errors", F.concat("s.errors", lost, F.when(F.col("repeated").isNotNull(), F.array("repeated"))
                           .otherwise(F.array().cast("array<string>"))))
    return out.select("conv", "call_id", "depth", F.coalesce("at", "rat").alias("at"), status.alias("status"),
                      F.coalesce("calls", F.lit(0)).cast("long").alias("calls"),
                      F.coalesce("results", F.lit(0)).cast("long").alias("results"),
                      (F.size("errors") == 0).alias("valid"), "errors", F.col("s.json").alias("json"))


#: Tools that turns of ``conversations`` are taken to call.
_TEXT = {"type": "string", "minLength": 1}
SCHEMAS = {
    "answer": {"type": "object", "properties": {"prompt": _TEXT, "turn": {"type": "integer", "minimum": 0}},
               "required": ["prompt", "turn"], "additionalProperties": False},
    "configure": {"type": "object", "properties": {"instruction": _TEXT}, "required": ["instruction"]},
}


def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn calls ``answer``, building on the call two turns before; a system turn calls
    ``configure``; an assistant turn is the result of the turn before it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "conv")
    call = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    asks = F.col("role") == "user"
    arguments = F.when(asks, F.to_json(F.struct("turn", F.col("text").alias("prompt")))).otherwise(
        F.to_json(F.struct(F.col("text").alias("instruction"))))
    calls = turns.where(asks | (F.col("role") == "system")).select(
        "conv", call(F.col("turn")).alias("call_id"), F.col("turn").alias("at"),
        F.when(asks, "answer").otherwise("configure").alias("name"), arguments.alias("arguments"),
        F.when(asks & (F.col("turn") >= 2), F.array(call(F.col("turn") - 2))).alias("after"))
    results = turns.where(F.col("role") == "assistant").select(
        "conv", call(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("at"), F.col("text").alias("content"))
    return link(calls, results, SCHEMAS).withColumnRenamed("conv", "conv_id")
