"""Extraction and privacy over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    BEARER, CARD, CORRECTIONS, ENVIRONMENT, MOST_RETRACTED, PASSWORD, PREDICATES, PRIVATE_KEY, STRICT, TOKEN, TOKENS,
    chunks, correction, first_sentences, jaccard, java, luhn_valid, normal_url, normalised, plain_text, predicate, scrubbed, scrubbed_json, strip, whole_word,
)
from ..jobs.catalog import query
from ..sources.ledger import Tables
from ..sources.scratch import saved


@query("with s as (select doc_id, text, unnest(case when length(text) <= 800 then [0] else range(0, length(text), 700) end) as start from documents) select doc_id, (start // 700)::int as chunk_index, start::int as char_start, sha256(substr(text, start::bigint + 1, 800)) as content_hash from s")
def chunks_800_100(t: Tables) -> DataFrame:
    """EXT-3: windows of 800 characters with 100 in common."""
    c = t("documents").select("doc_id", F.explode(chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", F.col("c.index").alias("chunk_index"), F.col("c.start").alias("char_start"), F.sha2("c.chunk", 256).alias("content_hash"))


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _sentences(x: str) -> str:
    """The first sentences as SQL."""
    flat = _strip(f"regexp_replace({x}, '[`*_#]', '', 'g')")
    return f"(case when len(regexp_extract_all({flat}, '[^.!?]+[.!?]')) > 0 then array_to_string(list_transform(regexp_extract_all({flat}, '[^.!?]+[.!?]')[1:3], lambda y: {_strip('y')}), ' ') else {_strip(f'left({flat}, 300)')} end)"


def _predicate(heading: str, text: str) -> str:
    return "(case " + " ".join(f"when regexp_matches({heading} || ' ' || left({text}, 200), '{whole_word(w)}') then '{name}'" for name, w in PREDICATES) + " else 'describes' end)"


@query(f"select doc_id, {_sentences('text')} as summary from documents")
def first_sentences_of(t: Tables) -> DataFrame:
    """EXT-4."""
    return t("documents").select("doc_id", first_sentences(F.col("text")).alias("summary"))


@query(f"select doc_id, {_predicate('source', 'text')} as predicate from documents")
def predicate_inference(t: Tables) -> DataFrame:
    """EXT-5."""
    return t("documents").select("doc_id", predicate(F.col("source"), F.col("text")).alias("predicate"))


@query(r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) as text from pages")
def html_to_text(t: Tables) -> DataFrame:
    """EXT-7: the contract's fallback."""
    return t("pages").select("page_id", plain_text(F.col("html")).alias("text"))


@query(r"with l as (select page_id, regexp_split_to_array(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\r\n?', chr(10), 'g'), '\n') as lines from pages) select page_id, " + _strip(r"regexp_replace(array_to_string(list_transform(lines, lambda y: " + _strip("y") + r"), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')") + " as text from l")
def normalize_text(t: Tables) -> DataFrame:
    """EXT-9: without tags, lines stripped, runs of blank lines as one."""
    return t("pages").select("page_id", normalised(F.col("html")).alias("text"))


_HEADING = r"^(#{1,6})\s+(.+)"


def paragraphs_of(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, position, paragraph, level, heading): what blank lines part, stripped; level and heading are null for what isn't a heading."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda x: x != "")
    p = docs.select(id_, F.posexplode(parts).alias("position", "paragraph"))
    heading = F.col("paragraph").rlike(_HEADING)
    return p.withColumn("level", F.when(heading, F.length(F.regexp_extract("paragraph", _HEADING, 1)))).withColumn("heading", F.when(heading, F.trim(F.regexp_extract("paragraph", _HEADING, 2))))


def with_heading_path(paragraphs: DataFrame, id_: str) -> DataFrame:
    """Adds path, the headings a paragraph stands under: the last of each level, unless one of a higher level came later.

    The window runs inside one document.
    """
    w = Window.partitionBy(id_).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    at = [F.max(F.when(F.col("level") == k, F.struct("position", "heading"))).over(w) for k in range(1, 7)]
    d = paragraphs.withColumns({f"_h{k}": x for k, x in enumerate(at, 1)})
    later = lambda k: F.greatest(F.lit(-1), F.lit(-1), *(F.col(f"_h{j}.position") for j in range(1, k)))
    path = F.filter(F.array(*(F.when(F.col(f"_h{k}.position") > later(k), F.col(f"_h{k}.heading")) for k in range(1, 7))), lambda x: x.isNotNull())
    return d.withColumn("path", path).drop(*(f"_h{k}" for k in range(1, 7)))


def markdown_chunks(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, chunk_id, chunk, path, is_heading): each paragraph in windows of 800 characters with 100 in common, numbered through the document."""
    p = with_heading_path(paragraphs_of(docs, id_, text), id_)
    c = p.select(id_, "position", F.explode(chunks(F.col("paragraph"))).alias("c"), "path", F.col("level").isNotNull().alias("is_heading"))
    n = F.row_number().over(Window.partitionBy(id_).orderBy("position", "c.index")) - 1
    return c.select(id_, F.concat(F.lit("c"), n).alias("chunk_id"), F.col("c.chunk").alias("chunk"), "path", "is_heading")


def markdown_facts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, subject, predicate, object, confidence, importance): of every heading the first paragraph right under it."""
    p = with_heading_path(paragraphs_of(docs, id_, text), id_).where("level is null and size(path) > 0").withColumn("subject", F.element_at("path", -1))
    first = p.withColumn("_k", F.row_number().over(Window.partitionBy(id_, "subject").orderBy("position"))).where("_k = 1")
    f = first.select(id_, "subject", predicate(F.col("subject"), F.col("paragraph")).alias("predicate"), first_sentences(F.col("paragraph")).alias("object"))
    return f.where("object != ''").withColumn("confidence", F.lit(0.8)).withColumn("importance", F.lit(0.5))


_PARAGRAPHS = (
    "with l as (select page_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{2,}'), lambda y: " + _strip("y") + "), lambda y: y != '') as l from notes), "
    "p as (select page_id, unnest(range(0, len(l))) as position, unnest(l) as paragraph from l), "
    f"h as (select *, case when regexp_matches(paragraph, '{_HEADING}') then length(regexp_extract(paragraph, '{_HEADING}', 1)) end as level, case when regexp_matches(paragraph, '{_HEADING}') then trim(regexp_extract(paragraph, '{_HEADING}', 2)) end as heading from p), "
)
_PATHS = (
    _PARAGRAPHS
    + "w as (select *, " + ", ".join(f"max(case when level = {k} then position end) over w as p{k}, max_by(heading, case when level = {k} then position end) over w as h{k}" for k in range(1, 7)) + " from h window w as (partition by page_id order by position rows unbounded preceding)), "
    + "y as (select *, list_filter([" + ", ".join(f"case when p{k} > coalesce(greatest(-1, {', '.join(f'p{j}' for j in range(1, k)) or '-1'}), -1) then h{k} end" for k in range(1, 7)) + "], lambda x: x is not null) as path from w) "
)


@query(_PARAGRAPHS + "h2 as (select * from h) select page_id, position::int as position, sha256(paragraph) as paragraph, level::int as level from h2", "notes")
def paragraphs(t: Tables) -> DataFrame:
    """EXT-1."""
    return paragraphs_of(t.notes(), "page_id", "text").select("page_id", "position", F.sha2("paragraph", 256).alias("paragraph"), "level")


@query(_PATHS + "select page_id, position::int as position, array_to_string(path, ' / ') as path from y", "notes")
def heading_paths(t: Tables) -> DataFrame:
    """EXT-2."""
    return with_heading_path(paragraphs_of(t.notes(), "page_id", "text"), "page_id").select("page_id", "position", F.array_join("path", " / ").alias("path"))


@query(_PATHS + ", z as (select page_id, position, path, level, unnest(case when length(paragraph) <= 800 then [0] else range(0, length(paragraph), 700) end) as start, paragraph from y) select page_id, 'c' || (row_number() over (partition by page_id order by position, start) - 1) as chunk_id, sha256(substr(paragraph, start::bigint + 1, 800)) as content_hash, array_to_string(path, ' / ') as path, level is not null as is_heading from z", "notes")
def markdown_chunk_rows(t: Tables) -> DataFrame:
    """EXT-2/3, UDF-5: the extractor's chunks."""
    return markdown_chunks(t.notes(), "page_id", "text").select("page_id", "chunk_id", F.sha2("chunk", 256).alias("content_hash"), F.array_join("path", " / ").alias("path"), "is_heading")


@query(_PATHS + f", z as (select page_id, path[len(path)] as subject, paragraph from y where level is null and len(path) > 0 qualify row_number() over (partition by page_id, path[len(path)] order by position) = 1) select page_id, subject, {_predicate('subject', 'paragraph')} as predicate, {_sentences('paragraph')} as object from z where {_sentences('paragraph')} != ''", "notes")
def heading_facts(t: Tables) -> DataFrame:
    """EXT-6, EXT-5."""
    return markdown_facts(t.notes(), "page_id", "text").select("page_id", "subject", "predicate", "object")


def model_facts(replies: DataFrame, id_: str, reply: str, text: str, most: int = 20) -> DataFrame:
    """(id, subject, predicate, object, confidence, importance) from a model's replies to chunks (id, chunk_index, reply, text).

    A reply is a JSON array, in fences, or somewhere in other words; what isn't is no fact.  The first ``most`` chunks of 30 characters at
    least count.  Facts with an empty part, a subject beyond 200 or an object beyond 300 characters are left out, as are those that a document
    has already (whatever the case, by 50 characters of the object).  Confidence is held between 0.3 and 1, 0.8 where none is said.
    """
    kind = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"
    bare = strip(F.array_join(F.filter(F.split(F.col(reply), "\n"), lambda x: ~F.trim(x).startswith("```")), "\n"))
    bare = F.when(strip(F.col(reply)).startswith("```"), bare).otherwise(strip(F.col(reply)))
    inner = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    rows = F.coalesce(F.when(bare.startswith("["), F.from_json(bare, kind)), F.from_json(inner, kind))
    r = replies.where((F.length(text) >= 30) & (F.col("chunk_index") < most)).select(id_, "chunk_index", F.posexplode(rows).alias("k", "f"))
    part = lambda n: F.coalesce(strip(F.col(f"f.{n}")), F.lit(""))
    f = r.select(id_, "chunk_index", "k", *(part(n).alias(n) for n in ("subject", "predicate", "object")), F.coalesce("f.confidence", F.lit(0.8)).alias("confidence"))
    f = f.where("subject != '' and predicate != '' and object != '' and length(subject) <= 200 and length(object) <= 300")
    w = Window.partitionBy(id_, F.lower("subject"), F.lower("predicate"), F.left(F.lower("object"), F.lit(50))).orderBy("chunk_index", "k")
    f = f.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return f.select(id_, "subject", "predicate", "object", F.least(F.greatest("confidence", F.lit(0.3)), F.lit(1.0)).alias("confidence"), F.lit(0.6).alias("importance"))


@query(
    "select doc_id, trim(source) as subject, lang as predicate, left(text, 100) as object, least(greatest((doc_id % 13) / 10.0::double, 0.3), 1.0) as confidence from documents where length(text) >= 30 and regexp_replace(left(text, 100), '\\s', '', 'g') != '' and lang is not null "
    "and doc_id % 3 != 2 and not regexp_matches(left(text, 100), '^\\s|\\s$')"
)
def model_fact_rows(t: Tables) -> DataFrame:
    """EXT-8: replies made of documents, in fences or in other words; each third is broken."""
    fact = F.to_json(F.array(F.struct(F.concat(F.lit(" "), "source").alias("subject"), F.col("lang").alias("predicate"), F.left("text", F.lit(100)).alias("object"), (F.col("doc_id") % 13 / F.lit(10.0)).alias("confidence"))))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), fact, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here they are: "), fact, F.lit(" Done."))).otherwise(F.left(fact, F.length(fact) - 9))
    d = t("documents").where(~F.left("text", F.lit(100)).rlike(r"^\s|\s$")).select("doc_id", F.lit(0).alias("chunk_index"), reply.alias("reply"), "text")
    return model_facts(d, "doc_id", "reply", "text").drop("importance")


def extract(notes: DataFrame, id_: str, replies: DataFrame | None = None) -> DataFrame:
    """Facts of documents (id, content, mime_type, source_uri): web pages give their plain text as one fact's source, others their headings' facts; a model's facts beside them."""
    web = F.col("mime_type").isin("text/html", "application/xhtml+xml") | F.col("source_uri").startswith("http")
    content = F.when(web, plain_text(F.col("content"))).otherwise(F.col("content"))
    facts = markdown_facts(notes.select(id_, content.alias("content")), id_, "content")
    return facts if replies is None else facts.unionByName(model_facts(replies, id_, "reply", "text"))


@query(_PATHS + f", z as (select page_id, path[len(path)] as subject, paragraph from y where level is null and len(path) > 0 qualify row_number() over (partition by page_id, path[len(path)] order by position) = 1), f as (select page_id, subject from z where {_sentences('paragraph')} != '') select page_id % 2 = 0 as web, count(subject) filter (page_id % 2 != 0) as facts from (select page_id from notes) n left join f using (page_id) group by 1", "notes")
def extractor_routes(t: Tables) -> DataFrame:
    """EXT-10: half of the pages are taken as they came, which has no headings, half as notes."""
    n = t.notes().join(t("pages").select("page_id", "html"), "page_id")
    rows = n.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.col("text")).alias("content"), F.when(F.col("page_id") % 2 == 0, "text/html").otherwise("text/markdown").alias("mime_type"), F.lit("file://").alias("source_uri"))
    f = extract(rows, "page_id").groupBy((F.col("page_id") % 2 == 0).alias("web")).agg(F.count(F.lit(1)).alias("facts"))
    return n.select((F.col("page_id") % 2 == 0).alias("web")).distinct().join(f, "web", "left").select("web", F.coalesce("facts", F.lit(0)).alias("facts"))


#: The address rule over a column ``url``.
_BARE = r"regexp_replace(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]', '', 'g'), '#.*$', '')"
_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*@)?([^/?@:]+)(:([0-9]*))?"
_ADDRESS = (
    f"(select case when u.s <> '' then u.s || '://' || u.w || lower(u.h) || case when u.p = '' or (u.s = 'http' and u.p = '80') or (u.s = 'https' and u.p = '443') then '' else ':' || u.p end || case when u.r = '/' then '' when u.r like '?%' then '/' || u.r else u.r end end "
    f"from (select lower(regexp_extract(b, '{_HEAD}', 1)) as s, regexp_extract(b, '{_HEAD}', 2) as w, regexp_extract(b, '{_HEAD}', 3) as h, regexp_extract(b, '{_HEAD}', 5) as p, replace(substr(b, length(regexp_extract(b, '{_HEAD}', 0)) + 1), ' ', '%20') as r from (select {_BARE} as b)) u)"
)


@query(f"select page_id, {_ADDRESS} as url from (select page_id, case page_id % 4 when 0 then '  HTTPS://Example.COM:443/' || page_id || ' a#x ' when 1 then upper(url) else url end as url from pages)")
def url_normalize(t: Tables) -> DataFrame:
    """DOM-9: addresses as they are, in capitals, and with blanks, the scheme's port and a fragment."""
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("  HTTPS://Example.COM:443/"), "page_id", F.lit(" a#x "))).when(k == 1, F.upper("url")).otherwise(F.col("url"))
    return t("pages").select("page_id", normal_url(url).alias("url"))


@query("with u as (select regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as host, count(*) as n from pages group by 1) select host, n, case when n > 5 then 'approved' else 'proposed' end as status from u order by n desc, host limit 50")
def crawl_listing(t: Tables) -> DataFrame:
    """DOM-9: the crawl queue by host."""
    u = t("pages").groupBy(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return u.orderBy(F.desc("n"), "host").limit(50).select("host", "n", F.when(F.col("n") > 5, "approved").otherwise("proposed").alias("status"))


_LUHN = "list_sum(list_transform(range(1, length({c}) + 1), lambda k: case when k % 2 = 1 then substr({c}, length({c}) - k + 1, 1)::int else (case when substr({c}, length({c}) - k + 1, 1)::int > 4 then substr({c}, length({c}) - k + 1, 1)::int * 2 - 9 else substr({c}, length({c}) - k + 1, 1)::int * 2 end) end))::int % 10 = 0"


def scrub_sql(source: str, id_: str, text: str, strict: bool = False) -> str:
    """Tables s0, s1, ... of (id, t, n), rule after rule; the last one's name is ``scrubbed``."""
    steps = [f"s0 as (select {id_}, {text} as t, 0 as n from {source})"]
    for pattern, to in (PRIVATE_KEY, BEARER, *((p, TOKEN) for p in TOKENS)):
        k = len(steps)
        steps.append(f"s{k} as (select {id_}, regexp_replace(t, '{pattern}', '{to}', 'g') as t, n + coalesce(len(regexp_extract_all(t, '{pattern}')), 0) as n from s{k - 1})")
    rules = [(CARD[0], _LUHN.format(c="regexp_replace(x, '[^0-9]', '', 'g')"), f"'{CARD[1]}'")]
    rules += [(p, "not contains(x, 'REDACTED')", f"regexp_extract(x, '{p}', 1) || '{to}'") for p, to in (ENVIRONMENT, PASSWORD)]
    rules += [(STRICT[0], "true", f"'{STRICT[1]}'")] if strict else []
    for pattern, judge, new in rules:
        k = len(steps)
        steps.append(f"h{k} as (select {id_}, t, n, regexp_extract_all(t, '{pattern}') as h, regexp_split_to_array(t, '{pattern}') as p from s{k - 1})")
        joined = f"array_to_string(list_transform(list_zip(p, list_transform(h, lambda x: case when {judge} then {new} else x end)), lambda z: z[1] || coalesce(z[2], '')), '')"
        steps.append(f"s{len(steps)} as (select {id_}, case when len(h) > 0 then {joined} else t end as t, n + coalesce(len(list_filter(h, lambda x: {judge})), 0) as n from h{k})")
    return ", ".join(steps) + f", scrubbed as (select {id_}, t, n from s{len(steps) - 1})"


@query("with " + scrub_sql("documents", "doc_id", "text") + " select doc_id, sha256(t) as scrubbed, n::bigint as redactions from scrubbed")
def pii_scrub(t: Tables) -> DataFrame:
    """PII-1: the rules in order."""
    return scrubbed(t("documents").select("doc_id", "text"), "text").select("doc_id", F.sha2("text", 256).alias("scrubbed"), "redactions")


@query("with " + scrub_sql("documents", "doc_id", "text", True) + " select doc_id, sha256(t) as scrubbed, n::bigint as redactions from scrubbed")
def pii_scrub_strict(t: Tables) -> DataFrame:
    """PII-1, strict: any long number too."""
    return scrubbed(t("documents").select("doc_id", "text"), "text", True).select("doc_id", F.sha2("text", 256).alias("scrubbed"), "redactions")


@query("with " + scrub_sql("(select doc_id, '{\"note\":\"' || regexp_replace(text, '[\\x00-\\x1f\"\\\\]', ' ', 'g') || '\"}' as p from documents)", "doc_id", "p") + " select doc_id, n::bigint as redactions, not json_valid(t) as wrapped from scrubbed")
def pii_envelopes(t: Tables) -> DataFrame:
    """PII-2: payloads whose JSON a redaction breaks are wrapped."""
    d = t("documents").select("doc_id", F.concat(F.lit('{"note":"'), F.regexp_replace("text", '[\\x00-\\x1f"\\\\]', " "), F.lit('"}')).alias("payload"))
    return scrubbed_json(d, "payload").select("doc_id", "redactions", F.get_json_object("payload", "$._redacted_raw").isNotNull().alias("wrapped"))


@query("with " + scrub_sql("documents", "doc_id", "text") + " select count(*) as rows_scanned, count(*) filter (n > 0) as rows_with_pii, sum(n)::bigint as redactions, (select string_agg(doc_id::varchar, ',' order by doc_id) from (select doc_id from scrubbed where n > 0 order by doc_id limit 5)) as samples from scrubbed")
def pii_report(t: Tables) -> DataFrame:
    """PII-3: a scan that changes nothing, with five samples."""
    d = saved(scrubbed(t("documents").select("doc_id", "text"), "text").select("doc_id", "redactions"), "redactions")
    totals = d.agg(F.count(F.lit(1)).alias("rows_scanned"), F.count_if(F.col("redactions") > 0).alias("rows_with_pii"), F.sum("redactions").alias("redactions"))
    few = d.where("redactions > 0").orderBy("doc_id").limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("samples"))
    return totals.crossJoin(few)  # a row each


@query("with c as (select doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{13,19}\\b')) as card from documents) select doc_id, card, " + _LUHN.format(c="card") + " as valid from c")
def luhn_cards(t: Tables) -> DataFrame:
    """PII-1: card-like numbers and whether their check digit is right."""
    c = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(java(r"\b[0-9]{13,19}\b")), 0)).alias("card"))
    return c.withColumn("valid", luhn_valid(F.col("card")))


def corrections_in(turns: DataFrame, text: str) -> DataFrame:
    """Adds pattern and retracted (at most 500 characters) to the turns that take something back."""
    return turns.withColumn("pattern", correction(F.col(text))).where("pattern is not null").withColumn("retracted", F.left(text, F.lit(MOST_RETRACTED)))


_CORRECTED = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in CORRECTIONS) + " end"


@query(f"select doc_id, {_CORRECTED} as pattern, sha256(left(text, 500)) as retracted from documents where {_CORRECTED} is not null")
def corrections(t: Tables) -> DataFrame:
    """COR-1: texts that take something back, by the first pattern that they hold."""
    return corrections_in(t("documents"), "text").select("doc_id", "pattern", F.sha2("retracted", 256).alias("retracted"))


def uuid5(name: Column, namespace: str = str(uuid.NAMESPACE_URL)) -> Column:
    """Name-based identifiers: the SHA-1 of the namespace and the name, with the version's and the variant's bits."""
    h = F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), F.encode(name, "UTF-8")))
    at = lambda k, n: F.substr(h, F.lit(k), F.lit(n))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(at(17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def _uuid5_sql(name: str, namespace: str) -> str:
    h = f"sha1(unhex('{uuid.UUID(namespace).hex}') || encode({name}))"
    return f"(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int % 4 + 1)::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) from (select {h} as h))"


#: The namespaces of identifiers, and the version of the rules by which chains are made.
CHAINS = "5b9c1e7d-3b1c-5e7f-9c3a-7f8b1e2d4a6c"
INSIGHTS = str(uuid.NAMESPACE_URL)
CHAIN_POLICY = "l5-v1"


def chain_id(kind: Column, seed: Column, candidates: Column, policy: str = CHAIN_POLICY) -> Column:
    """The id of a reasoning chain: the same seed, policy and candidates, in whatever order, are the same chain."""
    return uuid5(F.concat_ws("|", kind, seed, F.lit(policy), F.array_join(F.sort_array(candidates), ",")), CHAINS)


@query("with c as (select conv_id, string_agg(turn::varchar, ',' order by turn::varchar) as ids from conversations where turn > 0 group by conv_id) select d.conv_id, " + _uuid5_sql(f"'fact|' || d.conv_id || '|{CHAIN_POLICY}|' || coalesce(c.ids, '')", CHAINS) + " as chain_id from (select distinct conv_id from conversations) d left join c using (conv_id)")
def uuid5_ids(t: Tables) -> DataFrame:
    """GRA-9: deterministic chain ids: a conversation's first turn is the seed, the others are the candidates."""
    c = t("conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") > 0, F.col("turn").cast("string"))).alias("ids"))
    return c.select("conv_id", chain_id(F.lit("fact"), F.col("conv_id").cast("string"), F.col("ids")).alias("chain_id"))


#: Characters of a part, and the similarity from which two parts in a row could be taken for one.
MOST_CHARS = 2_000
MOST_SIMILAR = 0.75


def packed(pieces: Column, between: str, most: int = MOST_CHARS) -> Column:
    """Pieces put together one after the other while they fit: a fold.  A piece that is too long by itself stays so."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, piece: Column) -> Column:
        fits = (s["now"] == "") | (F.length(s["now"]) + len(between) + F.length(piece) <= most)
        joined = F.when(s["now"] == "", piece).otherwise(F.concat(s["now"], F.lit(between), piece))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), F.when(fits, joined).otherwise(piece).alias("now"))

    return F.aggregate(F.filter(pieces, lambda x: x != ""), start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def split_insights(insights: DataFrame, content: str, project: Column, fact_ids: Column, synthesized_at: Column, most: int = MOST_CHARS) -> DataFrame:
    """The rows of ``insights`` in parts, with the trace of each: root_insight_id, fact_ids, chunk_index, total_chunks, split_strategy, synthesized_at, similarity, too_similar.

    One strategy holds for a whole text: ``none`` up to ``most`` characters; else paragraphs packed together; if a paragraph is too long, sentences; if a sentence is, ``hard-cut``.
    ``similarity`` is the share of words that a part has in common with the part before it (null for the first).  The root id is made of the project and the sorted ids, so it is the same
    for the same facts.  A null text gives no part, an empty one an empty part; columns of these names are replaced.
    """
    added = ("root_insight_id", "fact_ids", "chunk_index", "total_chunks", "split_strategy", "synthesized_at", "similarity", "too_similar")
    columns = [c for c in insights.columns if c not in added]
    d = insights.select(F.struct(*columns).alias("_row"), F.col(content).alias("_text"), project.alias("_project"), F.sort_array(fact_ids).alias("_ids"), synthesized_at.alias("_at")).where(F.col("_text").isNotNull())
    long_ = F.length("_text") > most
    too_long = lambda parts: F.exists(parts, lambda x: F.length(x) > most)
    d = d.withColumn("_parts", F.when(long_, packed(F.split("_text", r"\n\n+"), "\n\n", most)).otherwise(F.array("_text")))
    d = d.withColumn("_how", F.when(~long_, "none").when(~too_long(F.col("_parts")), "paragraph").otherwise("sentence"))
    d = d.withColumn("_parts", F.when(F.col("_how") == "sentence", packed(F.split("_text", r"(?<=[.!?])\s+"), " ", most)).otherwise(F.col("_parts")))
    d = d.withColumn("_how", F.when((F.col("_how") == "sentence") & too_long(F.col("_parts")), "hard-cut").otherwise(F.col("_how")))
    d = d.withColumn("_parts", F.when(F.col("_how") == "hard-cut", F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{most}}}"), 0)).otherwise(F.col("_parts")))
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    d = d.withColumn("_words", F.transform("_parts", words))
    root = uuid5(F.concat(F.coalesce("_project", F.lit("")), F.lit("|"), F.array_join("_ids", ",")), INSIGHTS)
    d = d.select("_row", "_parts", "_words", "_ids", "_at", "_how", root.alias("_root"), F.posexplode("_parts").alias("_k", "_part"))
    near = F.when(F.col("_k") > 0, jaccard(F.get("_words", F.col("_k") - 1), F.get("_words", F.col("_k"))))
    rows = [F.col("_part").alias(c) if c == content else F.col("_row").getField(c).alias(c) for c in columns]
    return d.select(*rows, F.col("_root").alias("root_insight_id"), F.col("_ids").alias("fact_ids"), F.col("_k").alias("chunk_index"), F.size("_parts").alias("total_chunks"), F.col("_how").alias("split_strategy"), F.col("_at").alias("synthesized_at"), near.alias("similarity"), (near >= MOST_SIMILAR).alias("too_similar"))


def _packed_sql(pieces: str, between: str) -> str:
    """``packed`` of a list; ``between`` is SQL for a string of one or two characters."""
    fits = f"len(s) > 0 and length(s[-1]) + length({between}) + length(x[1]) <= {MOST_CHARS}"
    return f"list_reduce([[]::varchar[]] || list_transform(list_filter({pieces}, lambda q: q <> ''), lambda q: [q]), lambda s, x: case when {fits} then s[:-2] || [s[-1] || {between} || x[1]] else s || x end)"


_PARAGRAPHS = _packed_sql(r"regexp_split_to_array(text, '\n\n+')", "chr(10) || chr(10)")
_SENTENCES = _packed_sql(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))", "' '")
_TOO_LONG = f"len(list_filter({{}}, lambda q: length(q) > {MOST_CHARS})) > 0"
_WORDS_OF = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"
_SPLIT = (
    "with d as (select doc_id, text, source from documents where text is not null), "
    f"p as (select *, case when length(text) <= {MOST_CHARS} then [text] else {_PARAGRAPHS} end as a from d), "
    f"s as (select *, case when length(text) <= {MOST_CHARS} then 'none' when {_TOO_LONG.format('a')} then 'sentence' else 'paragraph' end as how from p), "
    f"b as (select doc_id, text, source, how, case when how = 'sentence' then {_SENTENCES} else a end as c from s), "
    f"h as (select doc_id, text, source, case when how = 'sentence' and {_TOO_LONG.format('c')} then 'hard-cut' else how end as how, c from b), "
    f"e as (select doc_id, source, how, case when how = 'hard-cut' then list_transform(range(0, length(text), {MOST_CHARS}), lambda i: substr(text, i + 1, {MOST_CHARS})) else c end as c from h), "
    "u as (select *, unnest(range(len(c))) as k from e), "
    f"w as (select *, case when k > 0 then {_WORDS_OF.format('c[k]')} end as l, {_WORDS_OF.format('c[k + 1]')} as r from u), "
    "x as (select *, case when k > 0 then coalesce(len(list_intersect(l, r))::double / nullif(len(l) + len(r) - len(list_intersect(l, r)), 0), 0) end as similarity from w) "
    "select doc_id, " + _uuid5_sql("source || '|' || list_aggregate(list_sort(['f', doc_id::varchar]), 'string_agg', ',')", INSIGHTS) + " as root_insight_id, k::int as chunk_index, len(c)::int as total_chunks, how as split_strategy, sha256(c[k + 1]) as content, round(similarity, 9) as similarity, similarity >= 0.75 as too_similar from x"
)


@query(_SPLIT)
def insight_split(t: Tables) -> DataFrame:
    """EXT-11, WIN-8: texts as insights in parts, each part beside the one before it."""
    d = t("documents").select("doc_id", "text", "source")
    s = split_insights(d, "text", F.col("source"), F.array(F.lit("f"), F.col("doc_id").cast("string")), F.lit("2024-02-01T00:00:00Z"))
    return s.select("doc_id", "root_insight_id", "chunk_index", "total_chunks", "split_strategy", F.sha2("text", 256).alias("content"), F.round("similarity", 9).alias("similarity"), "too_similar")
