"""Request lines to responses: parsing, dispatch, argument checks, envelopes. All by Spark's own functions."""

from __future__ import annotations

import json
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import classify, rules
from webloom.functions import url as urls
from webloom.functions.url import Name, _c


class Argument(NamedTuple):
    """path below the arguments; kind: string, boolean, count, level or object; note for people; whether it has to be there, whether
    null stands for nothing, what is taken without it."""

    path: str
    kind: str
    note: str
    required: bool = False
    nullable: bool = False
    default: str | int | bool | None = None


#: What each kind of call takes. Misfits are looked for in the order of the names, absent ones last.
ARGUMENTS = {
    "search": (
        Argument("options", "object", "How to search.", nullable=True),
        Argument("options.num_results", "count", "How many results to give at most.", default=10),
        Argument("options.region", "string", "The region to search for, as us-en; wt-wt for all.", default="wt-wt"),
        Argument("options.safe_search", "level", "How strictly to filter.", default="MODERATE"),
        Argument("options.time_range", "string", "How far back: d, w, m or y.", nullable=True),
        Argument("query", "string", "What to search for.", required=True),
    ),
    "fetch": (
        Argument("include_images", "boolean", "Whether to keep references to images.", default=False),
        Argument("selector", "string", "A CSS selector of the part to take.", nullable=True),
        Argument("url", "string", "The page to visit.", required=True),
    ),
    "crawl": (
        Argument("concurrency", "count", "How many pages to fetch at a time.", default=4),
        Argument("max_pages", "count", "How many pages to fetch at most.", default=25),
        Argument("root_url", "string", "Where the site begins.", required=True),
    ),
}
#: The names that misfits give to objects, and to what is expected.
SHAPES = {"search": "struct SearchArgs", "fetch": "struct VisitPageArgs", "crawl": "struct CrawlArgs", "options": "struct SearchOptions"}
EXPECTED = {"string": "a string", "boolean": "a boolean", "count": "usize", "level": "string or map"}
JSON_TYPES = {"string": "string", "boolean": "boolean", "count": "integer", "level": "string", "object": "object"}
DECODED = {"string": "string", "boolean": "boolean", "count": "long", "level": "string"}

#: name, description, kind of call.
TOOLS = (
    ("web_search", "Search many sources at once and merge what they give.", "search"),
    ("search_duckduckgo", "The same as web_search, by its older name.", "search"),
    ("visit_page", "Get a page and give its content as Markdown.", "fetch"),
    ("crawl_site", "Find a site's pages, visit up to max_pages of them and give their content.", "crawl"),
)


def input_schema(kind: str) -> dict:
    """The JSON schema of a kind of call."""
    whole: dict = {"type": "object", "properties": {}}
    for a in sorted(ARGUMENTS[kind], key=lambda x: x.path.count(".")):
        *above, name = a.path.split(".")
        at = reduce(lambda x, n: x["properties"][n], above, whole)
        own: dict = {"type": JSON_TYPES[a.kind], "description": a.note}
        own |= {"enum": list(rules.SAFE_SEARCH)} if a.kind == "level" else {}
        own |= {"properties": {}} if a.kind == "object" else {}
        own |= {} if a.default is None else {"default": a.default}
        at["properties"][name] = own
    whole["required"] = [a.path for a in ARGUMENTS[kind] if a.required]
    return whole


def tools(spark) -> DataFrame:
    """name, description, required arguments, input_schema (JSON)."""
    rows = [(n, d, [a.path for a in ARGUMENTS[k] if a.required], json.dumps(input_schema(k))) for n, d, k in TOOLS]
    return spark.createDataFrame(rows, "name string, description string, required array<string>, input_schema string")


def tools_json() -> str:
    return json.dumps({"tools": [{"name": n, "description": d, "inputSchema": input_schema(k)} for n, d, k in TOOLS]})


def server_info(spark) -> DataFrame:
    return spark.createDataFrame([(rules.PROTOCOL, "webloom", "1")], "protocol_version string, name string, version string")


def info_json() -> str:
    return json.dumps({"protocolVersion": rules.PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "webloom", "version": "1"}})


def text_of(v: Column, path: str) -> Column:
    """A field of a variant if it is a string."""
    own = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(v, path, "string"))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Of lines that are not blank: request (a variant, null if the line is no JSON object), id, method, params, notification."""
    v = F.try_parse_json(F.col(line))
    rows = lines.filter(F.trim(F.regexp_replace(line, r"\s", " ")) != "").withColumn("_v", v)
    rows = rows.withColumns({"id": F.try_variant_get("_v", "$.id", "variant"), "method": text_of(F.col("_v"), "$.method"), "params": F.try_variant_get("_v", "$.params", "variant")})
    good = F.col("_v").isNotNull() & F.col("method").isNotNull()
    return rows.withColumns({"valid": good, "notification": good & classify.is_notification("id")}).drop("_v")


def unexpected(value: Column, kind: Column) -> Column:
    """A JSON value (a variant and its type) as misfits name it."""
    shown = F.to_json(value)
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return (
        F.when(kind == "STRING", F.concat(F.lit("string "), shown))
        .when(whole, F.concat(F.lit("integer `"), shown, F.lit("`")))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.concat(F.lit("floating point `"), shown, F.when(shown.rlike("[.eE]"), "").otherwise(".0"), F.lit("`")))
        .when(kind == "BOOLEAN", F.concat(F.lit("boolean `"), shown, F.lit("`")))
        .when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "sequence")
        .otherwise("map")
    )


def _once(value: Column, use) -> Column:
    """What ``use`` makes of a value that is evaluated once, however often it is used; it stays out of the generated code."""
    return F.transform(F.array(value), use)[0]


def cause_of(a: Argument, value: Column, kind: Column) -> Column:
    """Why a value (a variant that is there, and its type) is none for the argument; null if it is."""
    wrong = F.concat(F.lit("invalid type: "), unexpected(value, kind), F.lit(f", expected {SHAPES.get(a.path, EXPECTED.get(a.kind, ''))}"))
    shown = F.to_json(value)
    if a.kind == "count":
        whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|20),0\)$")
        return F.when(~whole, wrong).when(shown.startswith("-"), F.concat(F.lit("invalid value: integer `"), shown, F.lit("`, expected usize")))
    if a.kind == "level":
        levels = ", ".join(f"`{x}`" for x in rules.SAFE_SEARCH)
        return F.when(kind != "STRING", wrong).when(~shown.isin(*(f'"{x}"' for x in rules.SAFE_SEARCH)), F.concat(F.lit("unknown variant `"), F.try_variant_get(value, "$", "string"), F.lit(f"`, expected one of {levels}")))
    fits = {"string": kind == "STRING", "boolean": kind == "BOOLEAN", "object": kind.startswith("OBJECT")}[a.kind]
    return F.when(~fits, wrong)


def misfit_of(a: Argument, given: Column) -> Column:
    """struct<path, cause> if the argument, of what is given, is of another kind; else null."""
    value = F.try_variant_get(given, f"$.{a.path}", "variant")
    there = lambda x: x["v"].isNotNull() & (F.lit(not a.nullable) | (x["k"] != "VOID"))
    cause = _once(F.struct(value.alias("v"), F.schema_of_variant(value).alias("k")), lambda x: F.when(there(x), cause_of(a, x["v"], x["k"])))
    return _once(cause, lambda c: F.when(c.isNotNull(), F.struct(F.lit(a.path).alias("path"), c.alias("cause"))))


def misfit(given: Column, kind: str) -> Column:
    """struct<path, cause> of the first argument of a call that does not fit what is declared; null if all do."""
    whole = F.schema_of_variant(given)
    shape = F.struct(F.lit("").alias("path"), F.concat(F.lit("invalid type: "), unexpected(given, whole), F.lit(f", expected {SHAPES[kind]}")).alias("cause"))
    absent = lambda a: F.when(F.try_variant_get(given, f"$.{a.path}", "variant").isNull(), F.struct(F.lit(a.path).alias("path"), F.lit(f"missing field `{a.path}`").alias("cause")))
    own = [misfit_of(a, given) for a in ARGUMENTS[kind]] + [absent(a) for a in ARGUMENTS[kind] if a.required]
    return F.when(~whole.startswith("OBJECT"), shape).otherwise(F.coalesce(*own))


def decoded(given: Column, kind: str) -> dict[str, Column]:
    """The arguments of a call by name, of their types, with what is taken for absent ones."""
    out = {}
    for a in ARGUMENTS[kind]:
        if a.kind != "object":
            value = F.try_variant_get(given, f"$.{a.path}", DECODED[a.kind])
            out[a.path.split(".")[-1]] = value if a.default is None else F.coalesce(value, F.lit(a.default))
    return out


def dispatched(rows: DataFrame) -> DataFrame:
    """Add tool, arguments (a variant), action (what is to be done), the arguments by name, argument (the one that has to be
    there), code and message (of errors) and path (of the argument that does not fit), of parsed rows."""
    absent = F.col("params").isNull() | F.coalesce(F.is_variant_null("params"), F.lit(True))
    call = F.col("method") == "tools/call"
    tool = F.when(call & ~absent, F.coalesce(text_of(F.col("params"), "$.name"), F.lit("")))
    rows = rows.withColumn("tool", tool).withColumn("arguments", F.when(call & ~absent, F.coalesce(F.try_variant_get("params", "$.arguments", "variant"), F.parse_json(F.lit("{}")))))
    prefix = F.lit(None).cast("string")
    for name, _, kind in TOOLS:
        prefix = F.when(F.col("tool") == name, kind).otherwise(prefix)
    # In steps, so that the arguments are looked at once.
    rows = rows.withColumn("_prefix", prefix)
    prefix, given = F.col("_prefix"), F.col("arguments")
    of_kind = lambda x: F.coalesce(*(F.when(x["kind"] == kind, misfit(x["given"], kind)) for kind in ARGUMENTS))
    rows = rows.withColumn("_misfit", _once(F.struct(prefix.alias("kind"), given.alias("given")), of_kind))
    fits = F.col("_misfit").isNull()
    rows = rows.withColumns({name: F.when(fits & (prefix == kind), value) for kind in ARGUMENTS for name, value in decoded(given, kind).items()})
    rows = rows.withColumn("argument", F.coalesce("query", "url", "root_url"))
    facts = F.struct(
        "valid", "method", "tool", prefix.alias("prefix"), absent.alias("absent"), F.col("_misfit.cause").alias("cause"),
        ((prefix == "fetch") & ~urls.is_http(F.try_variant_get(given, "$.url", "string"))).alias("bad_url"),
    )
    # A generator of one row: filters by what is decided stay above it, so that nothing below is written into them again.
    rows = rows.withColumn("_d", F.explode(F.transform(F.array(facts), decided)))
    return rows.withColumns({**{k: F.col(f"_d.{k}") for k in ("action", "code", "message")}, "path": F.col("_misfit.path")}).drop("_prefix", "_misfit", "_d")


def decided(x: Column) -> Column:
    """action, code and message from the facts of a request."""
    call = x["method"] == "tools/call"
    action = (
        F.when(~x["valid"], "error")
        .when(x["method"] == "initialize", "info")
        .when(x["method"].isin("initialized", "notifications/initialized", "ping"), "empty")
        .when(x["method"] == "tools/list", "tools")
        .when(call & (x["absent"] | x["prefix"].isNull() | x["cause"].isNotNull()), "error")
        .when(call & x["bad_url"], "tool_error")
        .when(call, F.concat(F.lit("call:"), x["prefix"]))
        .otherwise("error")
    )
    code = F.when(~x["valid"], rules.PARSE_ERROR).when(call & x["absent"], rules.BAD_PARAMS).when(call & x["prefix"].isNull(), rules.NO_METHOD).when(call & x["cause"].isNotNull(), rules.BAD_PARAMS).otherwise(rules.NO_METHOD)
    message = (
        F.when(~x["valid"], "Parse error")
        .when(call & x["absent"], "Missing parameters")
        .when(call & x["prefix"].isNull(), F.concat(F.lit("Unknown tool: "), x["tool"]))
        .when(call & x["cause"].isNotNull(), F.concat(F.lit("Invalid "), x["prefix"], F.lit(" arguments: "), x["cause"]))
        .otherwise(F.concat(F.lit("Method not found: "), x["method"]))
    )
    failed = action == "error"
    shown = F.when(failed, message).when(action == "tool_error", "Invalid URL: must be HTTP or HTTPS")
    return F.struct(action.alias("action"), F.when(failed, code).alias("code"), shown.alias("message"))


def envelope(content: Name, is_error: Column | bool = False) -> Column:
    """A tool's answer as JSON; a tool's error is a success of the request."""
    flag = F.lit(is_error) if isinstance(is_error, bool) else is_error
    return F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), _c(content).alias("text"))).alias("content"), flag.alias("isError")))


def error_json(code: Name, message: Name) -> Column:
    return F.to_json(F.struct(_c(code).alias("code"), _c(message).alias("message")))


def response_lines(rows: DataFrame, result: str = "result") -> DataFrame:
    """response of dispatched rows: error, or the result (JSON, given for calls), with the request's id. Notifications get none."""
    own = F.when(F.col("action") == "tool_error", envelope("message", True)).when(F.col("action") == "empty", F.lit("{}")).otherwise(F.col(result) if result in rows.columns else F.lit(None).cast("string"))
    head = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce(F.to_json("id"), F.lit("null")))
    body = F.when(F.col("action") == "error", F.concat(F.lit(',"error":'), error_json("code", "message"))).otherwise(F.concat(F.lit(',"result":'), F.coalesce(own, F.lit("null"))))
    return rows.filter(~F.col("notification")).withColumn("response", F.concat(head, body, F.lit("}")))
