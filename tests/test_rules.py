"""Rules of the scheduler's gate, seeds, the insight splitter, addresses, and actions from observations; working columns that clash."""

import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import actions, maintenance, sequences, text_ops


def chains(spark, *verdicts):
    return spark.createDataFrame([(k, v) for k, v in enumerate(verdicts)], "verdict_at long, verdict string")


def test_gate_looks_at_the_last_judgements_whatever_came_after(spark):
    row = maintenance.gate(chains(spark, *["rejected"] * 20, *[None] * 20)).first()
    assert (row.decision, row.judged, row.rejected, row.skips, row.paused) == ("skipped_soft", 10, 10, 1, False)


def test_gate_states(spark):
    bad, good = chains(spark, *["confirmed"] * 5, *["rejected"] * 5, *[None] * 3), chains(spark, *["rejected"] * 5, *["confirmed"] * 10)
    run = lambda c, **k: maintenance.gate(c, **k).first()
    assert run(bad).decision == "skipped_soft" and run(good).decision == "ran" and run(good).skips == 0
    fourth = run(bad, skips=3)
    assert (fourth.decision, fourth.paused, fourth.skips) == ("skipped_hard_paused", True, 4)
    assert run(good, paused=True, paused_days=6.9).decision == "skipped_hard_paused" and run(good, paused=True).paused
    assert (run(good, paused=True, paused_days=7).decision, run(good, paused=True, paused_days=7).paused) == ("ran", False)
    again = run(bad, paused=True, paused_days=8, skips=4)  # the pause took the count with it
    assert (again.decision, again.skips, again.paused) == ("skipped_soft", 1, False)
    few = run(chains(spark, *["rejected"] * 9), paused=True, paused_days=1, skips=2)
    assert (few.decision, few.paused, few.skips) == ("skipped_below_entry", True, 2)
    assert run(chains(spark, *[None] * 8, *["rejected"] * 4)).decision == "ran"


def test_seeds_are_of_the_week_and_not_imported(spark):
    facts = spark.createDataFrame([(1, "a", 1, 0, False), (2, "b", 2, 1, False), (3, "b", 3, 0, False), (4, "c", 4, 7, False), (5, "d", 5, 2, True), (6, "e", 6, 3, False), (7, "f", 7, 4, False)], "fact_id long, subject string, observe_id long, age_days long, archived boolean")
    seen = spark.createDataFrame([(k, "memory" if k in (1, 3) else "x") for k in range(1, 8)], "observe_id long, adapter string")
    assert [tuple(r) for r in maintenance.seeds(facts, seen).collect()] == [("b", 2), ("e", 6), ("f", 7)]
    assert maintenance.seeds(facts, seen, budget=1).count() == 1


def by_hand(source: str, most: int) -> tuple[str, list[str]]:
    def pack(pieces, mark):
        out, now = [], ""
        for p in (x for x in pieces if x):
            joined = now + mark + p if now else p
            if len(joined) <= most:
                now = joined
            else:
                out += [now] if now else []
                now = p
        return out + [now] if now else out

    if len(source) <= most:
        return "none", [source]
    parts = pack(re.split(r"\n\n+", source), "\n\n")
    if max(map(len, parts), default=0) <= most:
        return "paragraph", parts
    parts = pack(re.split(r"(?<=[.!?])\s+", source), " ")
    if max(map(len, parts), default=0) <= most:
        return "sentence", parts
    return "hard-cut", [source[k : k + most] for k in range(0, len(source), most)]


def test_insight_parts(spark):
    words = "one two three four five"
    texts = ["", "short", "a" * 45, "x" * 21, f"{words}\n\n{words}\n\n\n{words}", "Is it! Yes it is? No. " * 5, "y" * 15 + "\n" + "z" * 15, "\n\n" * 30, "é" * 25, f"{words}\n\n{'w' * 30}", "ab. " * 20, None]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = text_ops.split_insights(d, "t", F.lit(None).cast("string"), F.array(F.lit("b"), F.lit("a")), F.lit("now"), most=20).orderBy("k", "chunk_index").collect()
    for k, source in enumerate(texts):
        mine = [(r.split_strategy, r.t, r.total_chunks) for r in got if r.k == k]
        how, parts = by_hand(source, 20) if source is not None else ("", [])
        assert mine == [(how, p, len(parts)) for p in parts], source
    assert {r.root_insight_id for r in got} == {str(uuid.uuid5(uuid.NAMESPACE_URL, "|a,b"))} and got[0].fact_ids == ["a", "b"]


def test_adjacent_insight_parts_that_are_alike(spark):
    d = spark.createDataFrame([("a b c d\n\nA b c d\n\nq r s t",)], "t string")
    got = text_ops.split_insights(d, "t", F.lit("p"), F.array(F.lit("f")), F.lit("now"), most=8).orderBy("chunk_index").collect()
    assert [(r.similarity, r.too_similar) for r in got] == [(None, None), (1.0, True), (0.0, False)]


def test_addresses_of_one_page_are_one(spark):
    cases = {
        "  HTTPS://Example.com:443/a#x ": "https://example.com/a", "http://Example.com:80": "http://example.com", "http://e.com:8080/": "http://e.com:8080", "https://e.com/?q=A b": "https://e.com/?q=A%20b", "https://e.com?q": "https://e.com/?q",
        "https://User@E.com/P": "https://User@e.com/P", "no address": None, "": None, None: None, "ftp://e.com:21/x": "ftp://e.com/x", "https://e.com/a%2fb": "https://e.com/a%2fb", "https://e.com:abc/": None, "http://[::1]:80/x": "http://[::1]/x",
    }
    d = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.v for r in d.withColumn("v", text.normal_url(F.col("u"))).collect()} == cases


def test_working_columns_do_not_clash(spark):
    d = spark.createDataFrame([("a password: x", 1, 2, 3, 4)], "x string, _t int, _n int, _row int, redactions int")
    r = text.scrubbed(d, "x").first()
    assert (r.x, r._t, r._n, r._row, r.redactions) == ("a password:[REDACTED]", 1, 2, 3, 1)
    d = spark.createDataFrame([("g", 1, 7, 8), ("g", 2, 9, 10)], "g string, at int, _slot int, _in int")
    r = sequences.with_previous(d, ["g"], F.col("at") / 10, ["at"], ["_slot"]).orderBy("at").collect()
    assert [(x._slot, x._in, x.before and x.before._slot) for x in r] == [(7, 8, None), (9, 10, 7)]


OBSERVED = "observe_id string, source_id string, source_uri string, source_kind string, occurred_at string, captured_at string, raw string, adapter string, adapter_sequence long, metadata string"


def observed(k, adapter, source, uri, raw, kind="local-dir", metadata=None, at="2026-05-03"):
    return (f"o{k}", source, uri, kind, at, f"2026-05-04 {k:02}", raw if isinstance(raw, str) or raw is None else json.dumps(raw), adapter, k, metadata)


@pytest.fixture(scope="module")
def acted(spark):
    home = "/home/me/Repos/own/Project"
    rows = [
        observed(1, "my-codex", f"codex:s:{home}", f"codex://{home}", {"kind": "codex-turn-summary", "session_id": "s1", "session_file": "/f.jsonl", "bytes": {"from": 1, "to": 240}, "assistant_messages": ["it landed", " "]}),
        observed(2, "codex-manual", "codex-live-2026-05-03", "local:x", "plain  text\n here"),
        observed(3, "a-zsh", "zsh:me@mac:1", f"zsh://mac{home}", {"command_id": "c-1", "command": "git status", "exit_status": 0, "cwd": home}),
        observed(4, "a-git", f"git:{home}", f"git:{home}@6ba9", {"commit_sha": "6ba90c1a2b3c4d5e", "subject": "feat: x", "repo_root": home}),
        observed(5, "a-notes", "notes:x", "notes://V/n.md", {"change_id": "ch", "vault_name": "V", "relative_path": "n/n.md", "event": "updated", "vault_root": "/v/V/"}),
        observed(6, "a-zsh", "zsh:me@mac:1", f"zsh://mac{home}", {"command_id": "c-1", "command": "again", "cwd": home}),
        observed(7, "web!!", "w", "https://e.com", "x" * 3000, kind="web", at=None), observed(8, "Odd Adapter", "w", "u://e", None, kind=None), observed(9, "hook", "h", "hook:///a/b", '{"session_id": 5, "prompt": "cut', kind=None),
        observed(10, "hook", "h", "hook:///a/b", {"session_id": "q", "hook_event_name": "Stop", "message": "bye", "cwd": "/"}), observed(11, "memory", "m", "memory://m/1", "[1]", metadata='{"memory_project": "P"}'),
    ]
    d = spark.createDataFrame(rows, OBSERVED)
    return d, {r.observe_id: r for r in actions.derived_actions(d.unionByName(d.where("observe_id = 'o1'"))).collect()}


def test_actions_by_adapter(acted):
    _, a = acted
    assert (a["o1"].source_system, a["o1"].action_source_id, a["o1"].who, a["o1"].what_text, a["o1"].project) == ("codex", "turn:s1:240", "codex", "Codex turn in Project: it landed", "Project")
    assert json.loads(a["o1"].artifact_locations)["codex_session_file"] == "/f.jsonl" and a["o1"].next_query_hint == "Project: Codex turn in Project: it landed"
    assert (a["o2"].action_source_id, a["o2"].what_text) == ("codex-live-2026-05-03", "plain text here")
    assert (a["o3"].action_source_id, a["o3"].what_text, a["o3"].project) == ("c-1", "zsh command in Project exited 0: git status", "Project")
    assert (a["o4"].action_source_id, a["o4"].what_text) == ("git:6ba90c1a2b3c4d5e", "git commit in Project 6ba90c1a2b3c: feat: x")
    assert (a["o5"].action_source_id, a["o5"].what_text, a["o5"].project) == ("ch", "Note in V updated: n/n.md", "V")
    assert json.loads(a["o5"].artifact_locations)["notes"] == {"vault": "V", "relative_path": "n/n.md", "path": None}
    assert a["o7"].source_system == "web" and len(a["o7"].what_text) == 1200 and a["o7"].what_text.endswith("...") and len(a["o7"].next_query_hint) == 240 and a["o7"].when_ts == "2026-05-04 07"
    assert (a["o8"].source_system, a["o8"].action_source_id, a["o8"].what_text) == ("odd-adapter", "w:8:o8", "Odd Adapter observation from u://e")
    assert (a["o9"].action_source_id, a["o9"].what_text) == ("h:9:o9", '{"session_id": 5, "prompt": "cut')
    assert (a["o10"].action_source_id, a["o10"].what_text) == ("q:Stop:10", "Hook Stop in /: bye")
    assert (a["o11"].action_source_id, a["o11"].what_text, a["o11"].project) == ("memory://m/1:11:o11", "Memory entry for P: [1]", "P")
    assert all("observation" in json.loads(x.artifact_locations) for x in a.values())


def test_actions_are_taken_up_once(spark, acted):
    d, a = acted
    assert len(a) == 11 and {k for k, r in a.items() if r.status != "inserted"} == {"o6"}
    log = spark.createDataFrame([("o3", "zsh", "c-1"), ("zz", "git", "git:6ba90c1a2b3c4d5e")], "source_observe_id string, source_system string, source_id string")
    again = {r.observe_id: r.status for r in actions.derived_actions(d, log).collect()}
    assert {k for k, v in again.items() if v == "duplicate"} == {"o3", "o4", "o6"}
    assert actions.derived_actions(d.limit(0)).count() == 0
