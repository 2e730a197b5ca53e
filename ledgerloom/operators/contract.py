"""The contract of extractors: what they are given and what they give back, checked, with errors as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..jobs.catalog import query
from ..sources.ledger import Tables

# The fields of a request and of a reply's facts, their types, and those that must be there.
REQUEST = {"observe_id": (str, True), "content": (str, True), "mime_type": (str, False)}
FACT = {"subject": (str, True), "predicate": (str, True), "object": (str, True), "confidence": (float, False)}
_NAMES = {str: "a text", float: "a number"}


def faults(value: object, fields: dict) -> list[str]:
    """What keeps an object from being one with these fields; other fields may be there."""
    if not isinstance(value, dict):
        return ["not an object"]
    out = []
    for name, (kind, needed) in fields.items():
        x = value.get(name)
        if x is None:
            out += [f"{name} is missing"] if needed else []
        elif not isinstance(x, (int, float) if kind is float else kind) or isinstance(x, bool):
            out.append(f"{name} is not {_NAMES[kind]}")
        elif kind is str and needed and not x.strip():
            out.append(f"{name} is empty")
        elif kind is float and not 0 <= x <= 1:
            out.append(f"{name} is not between 0 and 1")
    return out


def parsed(text: str | None) -> tuple[object, str | None]:
    """(value, fault) of a JSON text, in a fence or not."""
    if text is None:
        return None, "no text"
    bare = text.strip()
    if bare.startswith("```"):
        bare = bare.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        return json.loads(bare), None
    except ValueError:
        return None, "not JSON"


class Extracted:
    """A table function over (request, reply): a row for each fact that keeps the contract, and one for each fault.

    ``analyze`` refuses anything but two texts when a query is planned.  A reply is an object with a list ``facts``; where the request or the reply itself breaks the contract, that is the one row; of
    a reply that is partly right the right facts come through, and each wrong one is a row with its place and what is wrong.
    """

    @staticmethod
    def analyze(request: AnalyzeArgument, reply: AnalyzeArgument) -> AnalyzeResult:
        for name, x in (("request", request), ("reply", reply)):
            if not isinstance(x.dataType, (StringType, NullType)):
                raise ValueError(f"{name} must be a text, not {x.dataType.simpleString()}")
        schema = StructType().add("observe_id", StringType()).add("place", IntegerType()).add("subject", StringType()).add("predicate", StringType()).add("object", StringType())
        return AnalyzeResult(schema.add("confidence", DoubleType()).add("error", StringType()))

    def eval(self, request: str, reply: str):
        asked, fault = parsed(request)
        wrong = [fault] if fault else faults(asked, REQUEST)
        name = asked.get("observe_id") if isinstance(asked, dict) and isinstance(asked.get("observe_id"), str) else None
        if wrong:
            yield name, None, None, None, None, None, "request: " + "; ".join(wrong)
            return
        given, fault = parsed(reply)
        if not fault and not (isinstance(given, dict) and isinstance(given.get("facts"), list)):
            fault = "no list of facts"
        if fault:
            yield name, None, None, None, None, None, f"reply: {fault}"
            return
        for k, fact in enumerate(given["facts"]):
            if wrong := faults(fact, FACT):
                yield name, k, None, None, None, None, "fact: " + "; ".join(wrong)
            else:
                c = fact.get("confidence")
                yield name, k, fact["subject"].strip(), fact["predicate"].strip(), fact["object"].strip(), None if c is None else float(c), None


def register(spark: SparkSession, name: str = "extracted") -> None:
    """Makes the table function known to SQL: ``from t, lateral extracted(t.request, t.reply)``."""
    spark.udtf.register(name, F.udtf(Extracted))


@query(
    "with d as (select doc_id, source, lang, doc_id % 6 as c from documents) "
    "select doc_id::varchar as observe_id, 0 as place, source as subject, 'is' as predicate, lang as object, (doc_id % 11) / 10.0::double as confidence, null::varchar as error from d where c in (0, 1, 5) and doc_id % 11 <= 10 "
    "union all select doc_id::varchar, 1, null, null, null, null, 'fact: object is missing; confidence is not between 0 and 1' from d where c = 1 "
    "union all select doc_id::varchar, null, null, null, null, null, 'reply: not JSON' from d where c = 2 union all select doc_id::varchar, null, null, null, null, null, 'reply: no list of facts' from d where c = 3 "
    "union all select null, null, null, null, null, null, 'request: observe_id is not a text' from d where c = 4"
)
def extractor_contract(t: Tables) -> DataFrame:
    """UDF-5, EXT-10: replies that are right, partly right, cut off, of another shape, in a fence; requests with a wrong id."""
    c, k = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    fact = F.to_json(F.struct(F.col("source").alias("subject"), F.lit(" is ").alias("predicate"), F.col("lang").alias("object"), (F.col("doc_id") % 11 / F.lit(10.0)).alias("confidence")))
    right = F.concat(F.lit('{"facts":['), fact, F.lit("]}"))
    partly = F.concat(F.lit('{"facts":['), fact, F.lit(',{"subject":"x","predicate":"y","confidence":7}]}'))
    reply = F.when(c == 1, partly).when(c == 2, F.left(right, F.lit(20))).when(c == 3, "[1]").when(c == 5, F.concat(F.lit("```json\n"), right, F.lit("\n```"))).otherwise(right)
    request = F.when(c == 4, '{"observe_id":4,"content":"x"}').otherwise(F.concat(F.lit('{"observe_id":"'), k, F.lit('","content":"a text"}')))
    register(t.spark)
    t("documents").select(request.alias("request"), reply.alias("reply")).createOrReplaceTempView("_replies")
    return t.spark.sql("select x.* from _replies r, lateral extracted(r.request, r.reply) x")
