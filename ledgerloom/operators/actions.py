"""What was done, from observations: an ordered cascade of rules by source, over JSON that may be broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.catalog import query
from ..sources.ledger import Tables
from ..sources.scratch import saved

#: What an adapter's name holds, the start of its addresses, and the system that both stand for, in order of precedence.
SYSTEMS = [("codex", None, "codex"), ("hook", None, "hook"), ("zsh", "zsh://", "zsh"), ("git", "git:", "git"), ("notes", "notes://", "notes"), ("memory", "memory://", "memory")]
MOST_TEXT, MOST_HINT = 1_200, 240
#: What a source id looks like that is no other's.
UNIQUE = r"://|@|[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9a-f]{8,}-"

# ----------------------------------------------------------------------------- JSON


def json_object(text: Column) -> Column:
    """A text as a variant; null unless it is a JSON object.  What doesn't start as one isn't parsed, as a parser's errors are dear."""
    return F.try_parse_json(F.when(F.ltrim(text, F.lit(" \t\n\r\x0b\f\ufeff")).startswith("{"), text))


def text_at(v: Column, path: str, numbers: bool = False) -> Column:
    """The trimmed text at a path; null if it is blank or no text; ``numbers`` takes numbers, too."""
    x = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(x)
    text = _trimmed(F.try_variant_get(x, "$", "string"))
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when((kind == "STRING") | (is_number if numbers else F.lit(False)), text)


def last_text(v: Column, path: str) -> Column:
    """The last text that isn't blank of an array at a path."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.try_element_at(F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", _trimmed(F.try_variant_get(x, "$", "string")))), lambda x: x.isNotNull()), F.lit(-1))


def _trimmed(x: Column) -> Column:
    return F.when(x.rlike(r"\S"), F.regexp_replace(x, r"^\s+|\s+$", ""))


def one_line(x: Column) -> Column:
    """White space as single spaces; null if nothing else is there."""
    return F.when(x.rlike(r"\S"), F.trim(F.regexp_replace(x, r"\s+", " ")))


def start_of(x: Column, most: int) -> Column:
    """As much of a text as ``shortened`` looks at: what holds ``most + 1`` characters that aren't white space, or all such.  Its line starts as the text's, and is as long or longer than ``most``."""
    return F.regexp_extract(x, rf"^(?:\s*+\S){{0,{most + 1}}}+", 0)


def shortened(x: Column, most: int) -> Column:
    """White space as single spaces, and at most so many characters, with dots for what is left out."""
    return cut_off(F.coalesce(one_line(x), F.lit("")), most)


def cut_off(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(most - 3)), F.lit("...")))


# ----------------------------------------------------------------------------- rules


def project_of(path: Column) -> Column:
    """The folder that a path is about: the second one below ``Repos``, or the last one."""
    return _of_parts(_parts(path))


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _of_parts(parts: Column) -> Column:
    at = F.array_position(parts, "Repos")
    return F.coalesce(F.when(at > 0, F.get(parts, (at + 1).cast("int"))), F.try_element_at(parts, F.lit(-1)))


def _path_of(uri: Column) -> Column:
    cut = lambda head: F.when(uri.startswith(head), F.substr(uri, F.lit(len(head) + 1)))
    return F.coalesce(cut("file://"), cut("codex://"), cut("hook://"), F.when(uri.startswith("/"), uri))


def _or(*columns: Column) -> Column:
    return F.coalesce(*columns)


def _with(head: str, x: Column) -> Column:
    """``head`` and a text, or nothing where there is none."""
    return F.coalesce(F.concat(F.lit(head), x), F.lit(""))


def _quoted(x: Column) -> Column:
    """A text as JSON."""
    j = F.to_json(F.array(x))
    return F.coalesce(F.substr(j, F.lit(2), F.length(j) - 2), F.lit("null"))


def source_system(adapter: Column, uri: Column, kind: Column) -> Column:
    name = F.lower(adapter)
    out = None
    for part, head, system in SYSTEMS:
        is_it = (name == part if part == "memory" else name.contains(part)) | (uri.startswith(head) if head else F.lit(False))
        out = F.when(is_it, system) if out is None else out.when(is_it, system)
    clean = F.nullif(F.regexp_replace(F.regexp_replace(name, "[^a-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit(""))
    return out.when(kind.isin("web", "local-file", "local-dir"), kind).otherwise(F.coalesce(clean, F.lit("unknown")))


def once(*columns: Column) -> Column:
    """The columns as one struct, computed once a row: what refers to it isn't merged with it, or the rules would be written out again wherever their results are used."""
    return F.explode(F.array(F.struct(*columns)))


def action_fields(observations: DataFrame) -> DataFrame:
    """Adds the fields of an action to observations (observe_id, source_id, source_uri, source_kind, occurred_at, captured_at, raw, adapter, adapter_sequence, metadata).

    source_system, action_source_id, who, what_text, when_ts, project, artifact_locations (JSON) and next_query_hint follow from the adapter, the address and
    two JSON texts, ``raw`` and ``metadata``.  What isn't a JSON object counts as none, and a value of another type as missing; each rule falls
    back to a more general one.  Nulls in source_kind, raw and metadata are missing values; long texts are shortened as the action's own fields demand.
    """
    c = F.col
    # each step adds plain columns that the next ones use more than once: such a projection isn't merged with the next, so nothing in it is computed twice
    d = observations.select(F.struct(*observations.columns).alias("_o"), *(c(x).alias(x) for x in ("observe_id", "source_id", "source_uri", "source_kind", "occurred_at", "captured_at", "raw", "adapter", "adapter_sequence")), json_object(c("raw")).alias("p"), json_object(c("metadata")).alias("m"))
    keys = ("session_id", "hook_event_name", "tool_name", "cwd", "prompt", "message", "command_id", "command", "commit_id", "commit_sha", "short_sha", "subject", "repo_root", "change_id", "vault_name", "relative_path", "path", "event", "vault_root", "session_file", "transcript_path")
    found = {
        **{k: text_at(c("p"), f"$.{k}") for k in keys}, "tool_command": text_at(c("p"), "$.tool_input.command"), "exit_status": text_at(c("p"), "$.exit_status", True), "byte_to": text_at(c("p"), "$.bytes.to", True),
        "turn": F.try_variant_get("p", "$.kind", "string") == "codex-turn-summary", "said": last_text(c("p"), "$.assistant_messages"), "asked": last_text(c("p"), "$.user_messages"),
        **{f"m_{k}": text_at(c("m"), f"$.{k}") for k in ("memory_kind", "memory_project", "session_file", "transcript_path")}, "line": one_line(start_of(c("raw"), MOST_TEXT)), "system": source_system(c("adapter"), c("source_uri"), c("source_kind")), "uri_path": _path_of(c("source_uri")),
    }
    own = [x for x in d.columns if x not in ("raw", "m")]
    f = lambda k: c(f"f_{k}")
    d = d.select(*own, *(x.alias(f"f_{k}") for k, x in found.items()))
    uri = c("source_uri")
    rest = F.when(f("m_memory_project").isNull() & f("cwd").isNull() & f("repo_root").isNull(), F.coalesce(f("vault_root"), F.when(f("uri_path") != "", f("uri_path")), uri))
    d = d.select("*", _parts(f("cwd")).alias("_in_cwd"), _parts(f("repo_root")).alias("_in_repo"), _parts(rest).alias("_in_rest"))
    d = d.select("*", _of_parts(c("_in_cwd")).alias("_cwd"), _of_parts(c("_in_repo")).alias("_repo"), _of_parts(c("_in_rest")).alias("_rest"))
    project = F.when(f("m_memory_project").isNotNull(), f("m_memory_project")).when(f("cwd").isNotNull(), c("_cwd")).when(f("repo_root").isNotNull(), c("_repo")).otherwise(c("_rest"))
    d = d.select("*", project.alias("project"))
    system, seq = f("system"), c("adapter_sequence").cast("string")
    turn = (system == "codex") & F.coalesce(f("turn"), F.lit(False))
    general = F.concat_ws(":", c("source_id"), seq, c("observe_id").cast("string"))
    own_id = F.coalesce(
        F.when(turn, F.concat(F.lit("turn:"), f("session_id"), F.lit(":"), _or(f("byte_to"), seq))),
        F.when(system == "hook", F.concat(f("session_id"), F.lit(":"), f("hook_event_name"), F.lit(":"), seq)),
        F.when((system == "memory") & uri.startswith("memory://"), F.concat_ws(":", uri, seq, c("observe_id").cast("string"))),
        F.when(system == "zsh", f("command_id")), F.when(system == "git", _or(f("commit_id"), F.concat(F.lit("git:"), f("commit_sha")))), F.when(system == "notes", f("change_id")),
        F.when(system.isin("codex", "hook") & c("source_id").rlike(UNIQUE), c("source_id")), general,
    )
    there = c("p").isNotNull()
    label = F.nullif(F.concat_ws(" ", f("hook_event_name"), f("tool_name")), F.lit(""))
    what = (
        F.when(turn, F.concat(F.lit("Codex turn"), _with(" in ", c("project")), F.lit(": "), _or(f("said"), f("asked"), F.lit("turn ended"))))
        .when((system == "hook") & there, F.concat(F.lit("Hook"), _with(" ", label), _with(" in ", _or(c("_cwd"), f("cwd"))), F.lit(": "), _or(f("tool_command"), f("prompt"), f("message"), f("line"), F.lit("event captured"))))
        .when((system == "memory") | f("m_memory_kind").isNotNull(), F.concat(F.lit("Memory "), _or(f("m_memory_kind"), F.lit("entry")), _with(" for ", f("m_memory_project")), F.lit(": "), _or(f("line"), uri)))
        .when((system == "zsh") & there, F.concat(F.lit("zsh command"), _with(" in ", _or(c("_cwd"), f("cwd"), c("project"))), _with(" exited ", f("exit_status")), F.lit(": "), _or(f("command"), f("line"), F.lit("command captured"))))
        .when((system == "git") & there, F.concat(F.lit("git commit"), _with(" in ", _or(c("_repo"), f("repo_root"), c("project"))), _with(" ", _or(f("short_sha"), F.left(f("commit_sha"), F.lit(12)))), F.lit(": "), _or(f("subject"), f("line"), F.lit("commit captured"))))
        .when((system == "notes") & there, F.concat(F.lit("Note"), _with(" in ", f("vault_name")), F.lit(" "), _or(f("event"), F.lit("changed")), F.lit(": "), _or(f("relative_path"), f("path"), F.lit("note changed"))))
        .otherwise(_or(f("line"), F.concat(c("adapter"), F.lit(" observation from "), uri)))
    )
    entry = lambda name, x: F.coalesce(F.concat(F.lit(f',"{name}":'), F.when(x.isNotNull(), _quoted(x))), F.lit(""))
    parts = lambda **kv: F.concat(F.lit("{"), *(y for k, (name, x) in enumerate(kv.items()) for y in (F.lit(("," if k else "") + f'"{name}":'), x)), F.lit("}"))
    origin = parts(observe_id=_quoted(c("observe_id").cast("string")), adapter=_quoted(c("adapter")), adapter_sequence=seq, source_id=_quoted(c("source_id")), source_uri=_quoted(uri), source_kind=_quoted(c("source_kind")))
    vault = F.when(_or(f("vault_name"), f("relative_path"), f("path")).isNotNull(), F.concat(F.lit(',"notes":'), parts(vault=_quoted(f("vault_name")), relative_path=_quoted(f("relative_path")), path=_quoted(f("path")))))
    where = F.concat(
        F.lit('{"observation":'), origin, entry("codex_session_file", _or(f("session_file"), f("m_session_file"))), entry("transcript_path", _or(f("transcript_path"), f("m_transcript_path"))), entry("cwd", _or(f("cwd"), F.when(f("uri_path") != "", f("uri_path")))),
        entry("memory_uri", F.when(uri.startswith("memory://"), uri)), entry("git_ref", F.when(uri.startswith("git:"), uri)), F.coalesce(vault, F.lit("")), entry("file_path", F.when(uri.startswith("file://"), F.substr(uri, F.lit(8)))), F.lit("}"),
    )
    d = d.select("*", what.alias("_all"))
    d = d.select("*", start_of(c("_all"), MOST_TEXT).alias("_start"))
    d = d.select("*", one_line(c("_start")).alias("_what"))
    d = d.select("*", F.concat(F.coalesce(F.concat("project", F.lit(": ")), F.lit("")), "_what").alias("_hint"))
    d = d.select("*", one_line(c("_hint")).alias("_line"))
    hint = F.when(c("_what").isNotNull(), cut_off(c("_line"), MOST_HINT))
    added = {"source_system": system, "action_source_id": own_id, "who": system, "what_text": cut_off(F.coalesce("_what", F.lit("")), MOST_TEXT), "when_ts": _or(F.nullif(c("occurred_at"), F.lit("")), c("captured_at")), "project": c("project"), "artifact_locations": where, "next_query_hint": hint}
    return d.select(*(F.col("_o").getField(x).alias(x) for x in observations.columns if x not in added), *(x.alias(k) for k, x in added.items()))


def derived_actions(observations: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Every observation with its action's fields, action_id and status: inserted, duplicate or skipped.

    An observation that ``log`` (source_observe_id, source_system, source_id) has taken up is a duplicate, and so is one whose action, by system and id, the log has or an
    observation before it (captured_at, adapter_sequence, observe_id) has given.  No text: skipped.  Rows with the same observe_id are one observation, the first.
    The first stage is a join on the observation, the second a minimum by the action's identity, so no group is sorted.
    """
    order = F.struct("captured_at", "adapter_sequence", "observe_id")
    o = observations.groupBy("observe_id").agg(F.min_by(F.struct(*observations.columns), order).alias("_x")).select("_x.*")
    known = F.lit(False)
    if log is not None:
        seen = log.select(F.col("source_observe_id").alias("observe_id"), F.lit(True).alias("_seen")).distinct()
        o = o.join(seen, "observe_id", "left")
        known = F.coalesce("_seen", F.lit(False))
    a = saved(action_fields(o.withColumn("_known", known).drop("_seen")), "actions")  # read for the first of each identity, and for the result
    empty = F.coalesce(F.col("what_text"), F.lit("")) == ""
    first = a.where(~F.col("_known") & ~empty).groupBy("source_system", "action_source_id").agg(F.min_by("observe_id", order).alias("_first"))
    if log is not None:
        taken = log.select("source_system", F.col("source_id").alias("action_source_id")).distinct()
        first = first.join(taken, ["source_system", "action_source_id"], "left_anti")
    new = first.select(F.col("_first").alias("observe_id"), F.lit(True).alias("_new"))
    a = a.join(new, "observe_id", "left")
    status = F.when(F.col("_known"), "duplicate").when(empty, "skipped").when(F.coalesce("_new", F.lit(False)), "inserted").otherwise("duplicate")
    action = F.sha2(F.concat_ws("|", "source_system", "action_source_id"), 256)
    return a.withColumn("status", status).withColumn("action_id", action).drop("_known", "_new")


# ----------------------------------------------------------------------------- query


def captured(t: Tables) -> DataFrame:
    """The activity log as observations of seven adapters, some of whose payloads are broken, cut short or repeated."""
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    of = lambda *values: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in values)), (k % 8 + 1).cast("int"))
    s = lambda text, *more: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in (text, *more)))
    cwd = s("/home/Repos/own/p", (F.col("user_id") % 7).cast("string"))
    raw = of(
        s('{"kind":"codex-turn-summary","session_id":"s', u, '","bytes":{"from":0,"to":', (k % 500).cast("string"), '},"assistant_messages":["first"," did ', F.col("event_type"), ' ",7,""]}'),
        s('{"hook_event_name":"PostToolUse","tool_name":"Bash","session_id":"h', u, '","cwd":"', cwd, '","tool_input":{"command":"ls  -l ', u, '"}}'),
        s('{"command_id":"c', (k % 300).cast("string"), '","command":"git status","exit_status":', (k % 3).cast("string"), ',"cwd":"', cwd, '/"}'),
        s('{"commit_sha":"0123456789abcdef', u, '","subject":"  ', F.col("event_type"), ' fixed","repo_root":"', cwd, '"}'),
        s('{"change_id":"n', (k % 400).cast("string"), '","vault_name":"Vault","relative_path":"a/', u, '.md","event":"updated"}'),
        s("remembered   ", F.col("event_type"), "\n by ", u), s('{"prompt":"broken'), s(""),
    )
    return t("events").select(
        k.alias("observe_id"), of(s("codex:", u), s("hook:", u), s("zsh:", u), s("git:", u), "notes", s("mem:", u), s("2024-05-0", (k % 9 + 1).cast("string"), "-live"), "f").alias("source_id"),
        of(s("codex://", cwd), "hook:///x", "zsh://host/x", s("git:", cwd, "@abc"), "notes://Vault/a.md", s("memory://m/", u), "local:launch", s("file:///data/", u, ".txt")).alias("source_uri"),
        of("local-dir", "local-dir", "local-dir", "local-dir", "local-dir", "memory", "local-dir", "local-file").alias("source_kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("captured_at"),
        raw.alias("raw"), of("codex", "hook", "zsh", "git", "notes", "memory", "codex-manual", "Plain File!").alias("adapter"), (k % 1000).alias("adapter_sequence"),
        F.when(k % 8 == 5, s('{"memory_kind":"note","memory_project":"p', (k % 4).cast("string"), '"}')).when(k % 8 == 0, '{"session_file":"/s.jsonl"}').alias("metadata"),
    )


# the rules once more, in SQL's own words: one branch for each of the eight kinds of rows
_ACTIONS = """
with e as (select event_id as k, user_id as u, event_type as t, strftime(ts, '%Y-%m-%d %H:%M:%S') as at_, '/home/Repos/own/p' || (user_id % 7) as cwd, 'p' || (user_id % 7) as pr, event_id % 8 as c, event_id % 1000 as seq from events),
f as (
  select *,
    case c when 0 then 'codex' when 1 then 'hook' when 2 then 'zsh' when 3 then 'git' when 4 then 'notes' when 5 then 'memory' when 6 then 'codex' else 'local-file' end as source_system,
    case c when 0 then 'turn:s' || u || ':' || (k % 500) when 1 then 'h' || u || ':PostToolUse:' || seq when 2 then 'c' || (k % 300) when 3 then 'git:0123456789abcdef' || u when 4 then 'n' || (k % 400)
      when 5 then 'memory://m/' || u || ':' || seq || ':' || k when 6 then '2024-05-0' || (k % 9 + 1) || '-live' else 'f:' || seq || ':' || k end as source_id,
    case c when 0 then pr when 1 then pr when 2 then pr when 3 then pr when 4 then 'a.md' when 5 then 'p' || (k % 4) when 6 then 'local:launch' else u || '.txt' end as project,
    case c when 0 then 'Codex turn in ' || pr || ': did ' || t when 1 then 'Hook PostToolUse Bash in ' || pr || ': ls -l ' || u when 2 then 'zsh command in ' || pr || ' exited ' || (k % 3) || ': git status'
      when 3 then 'git commit in ' || pr || ' 0123456789ab: ' || t || ' fixed' when 4 then 'Note in Vault updated: a/' || u || '.md' when 5 then 'Memory note for p' || (k % 4) || ': remembered ' || t || ' by ' || u
      when 6 then '{"prompt":"broken' else 'Plain File! observation from file:///data/' || u || '.txt' end as what_text,
    case c when 0 then 'codex' when 1 then 'hook' when 2 then 'zsh' when 3 then 'git' when 4 then 'notes' when 5 then 'memory' when 6 then 'codex-manual' else 'Plain File!' end as adapter,
    case c when 0 then 'codex:' || u when 1 then 'hook:' || u when 2 then 'zsh:' || u when 3 then 'git:' || u when 4 then 'notes' when 5 then 'mem:' || u when 6 then '2024-05-0' || (k % 9 + 1) || '-live' else 'f' end as sid,
    case c when 0 then 'codex://' || cwd when 1 then 'hook:///x' when 2 then 'zsh://host/x' when 3 then 'git:' || cwd || '@abc' when 4 then 'notes://Vault/a.md' when 5 then 'memory://m/' || u when 6 then 'local:launch' else 'file:///data/' || u || '.txt' end as uri,
    case c when 5 then 'memory' when 7 then 'local-file' else 'local-dir' end as kind
  from e),
g as (
  select *, '{"observation":{"observe_id":"' || k || '","adapter":"' || adapter || '","adapter_sequence":' || seq || ',"source_id":"' || sid || '","source_uri":"' || uri || '","source_kind":"' || kind || '"}'
    || case c when 0 then ',"codex_session_file":"/s.jsonl","cwd":"' || cwd || '"' when 1 then ',"cwd":"' || cwd || '"' when 2 then ',"cwd":"' || cwd || '/"' when 3 then ',"git_ref":"' || uri || '"'
         when 4 then ',"notes":{"vault":"Vault","relative_path":"a/' || u || '.md","path":null}' when 5 then ',"memory_uri":"' || uri || '"' when 7 then ',"cwd":"/data/' || u || '.txt","file_path":"/data/' || u || '.txt"' else '' end || '}' as artifact_locations,
    row_number() over (partition by source_system, source_id, k % 11 = 0 order by at_, seq, k) as rank,
    bool_or(k % 11 = 0) over (partition by source_system, source_id) as logged
  from f)
"""


@query(_ACTIONS + "select k as observe_id, source_system, source_id as action_source_id, source_system as who, what_text, at_ as when_ts, project, sha256(artifact_locations) as artifact_locations, project || ': ' || what_text as next_query_hint, case when k % 11 = 0 or logged or rank > 1 then 'duplicate' else 'inserted' end as status from g")
def action_derivation(t: Tables) -> DataFrame:
    """DOM-11: all fields of the derived actions; the log has every eleventh observation, and with it these actions."""
    o = captured(t)
    log = action_fields(o.where("observe_id % 11 = 0")).select(F.col("observe_id").alias("source_observe_id"), "source_system", F.col("action_source_id").alias("source_id"))
    a = derived_actions(o, log)
    return a.select("observe_id", "source_system", "action_source_id", "who", "what_text", "when_ts", "project", F.sha2("artifact_locations", 256).alias("artifact_locations"), "next_query_hint", "status")
