"""Model annotation of documents: prompts, batch records, results and their cost.

Calls to services are not part of this engine; it builds what they get and reads what they give.
"""

from __future__ import annotations

import json
import typing
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

FAILED = "FAIL"
_JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean"}


@dataclass
class Prompt:
    """System text, and what stands before and after the document."""

    system: str
    begin: str = ""
    end: str = ""

    def __post_init__(self) -> None:
        """A line end behind ``begin`` and ``end`` where they do not touch the document with white space."""
        if self.begin and not self.begin[-1].isspace():
            self.begin += "\n"
        if self.end and not self.end[0].isspace():
            self.end += "\n"

    @classmethod
    def load(cls, path: str, name: str) -> "Prompt":
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(**yaml.safe_load(f)[name])

    def user_text(self, content: Column, **values: Column) -> Column:
        """The document's prompt; ``{{name}}`` marks become the values."""
        out = F.concat(F.lit(self.begin), F.coalesce(content, F.lit("")), F.lit(self.end))
        for name, value in values.items():
            out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
        return out


def with_neighbours(df: DataFrame, key: str, order: str, text: str, group: str | None = None) -> DataFrame:
    """``df`` with ``previous_text`` and ``next_text`` in an order (ties by key), within a group.

    Rows are range-partitioned, so a large group spans many tasks; what lies beyond a partition's
    ends comes from a table of the ends of all partitions (one row a partition and group).
    """
    by = [*([group] if group else []), order, key]
    parts = df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    parts = cut_lineage(parts.withColumn("__group", F.col(group) if group else F.lit(0)))
    within = Window.partitionBy("__part", "__group").orderBy(order, key)
    rank = F.struct(F.col(order), F.col(key))
    ends = parts.groupBy("__part", "__group").agg(F.min_by(F.struct(F.col(text).alias("t")), rank).alias("first"), F.max_by(F.struct(F.col(text).alias("t")), rank).alias("last"))
    along = Window.partitionBy("__group").orderBy("__part")
    ends = ends.select("__part", F.col("__group").alias("__of"), F.lag("last").over(along).alias("__before"), F.lead("first").over(along).alias("__after"))
    placed = parts.withColumns({"__n": F.row_number().over(within), "previous_text": F.lag(text).over(within), "next_text": F.lead(text).over(within), "__left": F.count("*").over(Window.partitionBy("__part", "__group"))})
    joined = placed.join(ends.withColumnRenamed("__part", "__p"), (F.col("__part") == F.col("__p")) & F.col("__group").eqNullSafe(F.col("__of")))
    return joined.withColumns({
        "previous_text": F.when(F.col("__n") == 1, F.col("__before.t")).otherwise(F.col("previous_text")),
        "next_text": F.when(F.col("__n") == F.col("__left"), F.col("__after.t")).otherwise(F.col("next_text")),
    }).select(*df.columns, "previous_text", "next_text")


def json_schema(fields: dict[str, object]) -> dict:
    """JSON schema of fields with Python types: simple types, lists, dicts and nested fields."""

    def of(kind) -> dict:
        if isinstance(kind, dict):
            return {"type": "object", "properties": {k: of(v) for k, v in kind.items()}, "required": list(kind), "additionalProperties": False}
        if kind in _JSON_TYPES:
            return {"type": _JSON_TYPES[kind]}
        origin, args = typing.get_origin(kind), typing.get_args(kind)
        if origin is list:
            return {"type": "array", "items": of(args[0])}
        if origin is dict:
            return {"type": "object", "additionalProperties": of(args[1])}
        raise TypeError(f"no JSON type for {kind!r}")

    return of(fields)


def response_format(name: str, fields: dict[str, object]) -> dict:
    """The strict envelope in which a service takes a JSON schema."""
    return {"type": "json_schema", "json_schema": {"name": name, "schema": json_schema(fields), "strict": True}}


def last_key(fields: dict[str, object]) -> str:
    """Name of the last field."""
    return list(fields)[-1]


def as_string(values: Column) -> Column:
    """A struct as JSON text with all its fields, indented as people read it."""
    return F.to_json(values, {"pretty": "true", "ignoreNullFields": "false"})


def chat_records(df: DataFrame, key: str, prompt: Prompt, content: Column, model: str, format: dict | None = None, done: DataFrame | None = None, **values: Column) -> DataFrame:
    """``(custom_id, request)`` in the form of a chat service: method, address and body of each request."""
    todo = df.join(done.select(F.col("custom_id").alias(key)), key, "left_anti") if done is not None else df
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(turn("system", F.lit(prompt.system)), turn("user", prompt.user_text(content, **values)))
    body = [F.lit(model).alias("model"), messages.alias("messages")]
    if format is not None:
        body.append(F.parse_json(F.lit(json.dumps(format))).alias("response_format"))
    custom = F.col(key).cast("string")
    request = F.struct(custom.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(*body).alias("body"))
    return todo.select(custom.alias("custom_id"), F.to_json(request).alias("request"))


def batch_records(df: DataFrame, key: str, prompt: Prompt, content: Column, model: str, max_tokens: int = 1024, done: DataFrame | None = None) -> DataFrame:
    """``(custom_id, request)``: a JSON request of each document that is not done yet."""
    todo = df.join(done.select(F.col("custom_id").alias(key)), key, "left_anti") if done is not None else df
    message = F.struct(F.lit("user").alias("role"), prompt.user_text(content).alias("content"))
    params = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(prompt.system).alias("system"), F.array(message).alias("messages"))
    custom = F.col(key).cast("string")
    return todo.select(custom.alias("custom_id"), F.to_json(F.struct(custom.alias("custom_id"), params.alias("params"))).alias("request"))


def parsed_output(json: Column, schema: str) -> Column:
    """Fields of a JSON answer; broken JSON gives null."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def predicted(json: Column, name: str, default: bool = False) -> Column:
    """A boolean field of a JSON answer, else the default."""
    return F.coalesce(F.get_json_object(json, f"$.{name}").try_cast("boolean"), F.lit(default))


def aligned_results(df: DataFrame, key: str, results: DataFrame, value: Column, ok: Column) -> DataFrame:
    """``(custom_id, result)`` of every document: the value where the request succeeded, else FAIL."""
    good = results.where(ok).select(F.col("custom_id").alias("__id"), value.cast("string").alias("result"))
    return df.select(F.col(key).cast("string").alias("custom_id")).join(good, F.col("custom_id") == F.col("__id"), "left").select("custom_id", F.coalesce("result", F.lit(FAILED)).alias("result"))


def succeeded_ids(results: DataFrame, kind: str = "result_type") -> DataFrame:
    return results.where(F.col(kind) == "succeeded").select("custom_id")


@dataclass(frozen=True)
class TokenPrice:
    """Price of a token in and out; a batch costs half."""

    input: Decimal
    output: Decimal


#: Prices by model family.
PRICES = {
    "sonnet": TokenPrice(Decimal("0.000003"), Decimal("0.000015")),
    "opus": TokenPrice(Decimal("0.000015"), Decimal("0.000075")),
}


def token_cost(input_tokens: Column, output_tokens: Column, family: str = "sonnet", batch: bool = True) -> Column:
    """Exact cost of a request."""
    if family not in PRICES:
        raise ValueError(f"no price known for {family!r}")
    price, share = PRICES[family], Decimal("0.5") if batch else Decimal(1)
    tokens = [F.coalesce(c, F.lit(0)).cast("decimal(20,0)") for c in (input_tokens, output_tokens)]
    return (tokens[0] * F.lit(price.input * share).cast("decimal(14,9)") + tokens[1] * F.lit(price.output * share).cast("decimal(14,9)")).cast("decimal(38,12)")


def written_back(df: DataFrame, key: str, labels: DataFrame, label: str, overwrite: bool = True) -> DataFrame:
    """``df`` with ``label`` from ``labels`` (``key, label``); all rows of a key get it.

    Without ``overwrite`` a value that is there (not null or empty) stays.
    """
    new = labels.select(key, F.col(label).alias("__new"))
    joined = df.join(new, key, "left")
    old = F.nullif(F.col(label), F.lit("")) if label in df.columns else F.lit(None).cast("string")
    value = F.coalesce(F.col("__new"), old) if overwrite else F.coalesce(old, F.col("__new"))
    return joined.withColumn(label, value).drop("__new")


def kept_keys(record: Column, names: Sequence[str]) -> Column:
    return F.map_filter(record, lambda k, v: k.isin(list(names)))


def removed_keys(record: Column, names: Sequence[str]) -> Column:
    return F.map_filter(record, lambda k, v: ~k.isin(list(names)))


def annotation_text(url: Column, title: Column, description: Column, matches: Column, text: Column) -> Column:
    """The sheet that annotators get: header lines and the text; missing values are empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("URL: "), empty(url), F.lit("\nTitle: "), empty(title), F.lit("\nDescription: "), empty(description),
        F.lit("\nSearch terms: "), F.array_join(F.coalesce(matches, F.array().cast("array<string>")), ", "), F.lit("\n\n"), empty(text),
    )
