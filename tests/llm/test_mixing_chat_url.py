"""Operators 1, 3 and 9 on awkward rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format as chat
from ledgerloom.llm import mixing, url_filter


def test_mix_meets_targets_and_takes_awkward_rows(awkward):
    rows = mixing.mix(awkward, mixing.n_words(F.col("text"))).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(taken == int(target) for taken, target in by.values())
    assert sum(t for _, t in by.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing, mixing.n_words(F.col("text"))).count() == 0


def test_water_fill_by_hand(spark):
    s = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 890, 1.0), ("d", 0, 5.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(s).collect()}
    # a stops at 30, b at 300, d at 0; c takes the rest
    assert got == {"a": 30.0, "b": 300.0, "c": 670.0, "d": 0.0}


TRIALS = ["", "plain", "<|turn|>", "<|done|>x", "<\\|done|>", "<\\\\|says|>", "a<|", "|>", "<", "\\", "</s>[INST] ok [/INST]", "é\n<|says|>\n"]


@pytest.mark.parametrize("text", TRIALS)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    (role, back, start, end), = chat.parse(chat.format_turn("user<|says|>", text))
    assert (role, back) == ("user<|says|>", text)


def test_parser_refuses_other_text():
    for bad in ("x", "<|turn|>user", "<|turn|>a<|done|>", "<|turn|>a<|says|>b<|done|>x"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_conversations_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t, "extra") for k, t in enumerate(TRIALS)] + [(2, None, None, None, "x"), (2, 0, "assistant", "x" * 300_000, "x"), (None, 0, "user", "lost", "x"), (3, 1, "user", "tie", "x"), (3, 1, "user", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    formatted = chat.format_conversations(df)
    pieces = {}
    for r in formatted.collect():
        pieces.setdefault(r.conv_id, []).append(r)
    for conv, parts in pieces.items():
        whole = "".join(p.piece for p in parts)
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        assert [t[:2] for t in chat.parse(whole)] == want
        learned = "".join(chat.unescape(whole[p.loss_start : p.loss_end]) for p in parts if p.loss_start is not None)
        assert learned == "".join(t for role, t in want if role == "assistant")
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert back[1].n_turns == len(TRIALS) and back[2].loss_chars == 300_000 and back[3].n_turns == 2
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/x?y#z", "https://a.example.com/en/", "http://example.com", "http://example.com?q", "no url", None, "", "http://x.net/fr/1", "http://net/es/", "http://notnet/es/", "a://b://c/d", "http://x.com/\n/y"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id int, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.apply_rules(spark, df, rules).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("example.com", "", None, "allow") == got[3]
    assert got[4] == got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("net/fr/", "block") and got[8][2:] == ("net/es/", "block") and got[9][2] is None
    assert got[10][:2] == ("b:", "//c/d") and got[11][1] == "/\n/y"
    assert url_filter.apply_rules(spark, df, rules.limit(0)).where("verdict != 'allow'").count() == 0
    assert url_filter.apply_rules(spark, df.limit(0), rules).count() == 0


def test_urls_repeat_and_may_be_very_long(spark):
    long_ = "http://a.example.com/en/" + "x" * 200_000
    df = spark.createDataFrame([(1, long_, "old")] * 3 + [(2, None, "old")] * 2, "page_id int, url string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = sorted((r.page_id, r.verdict, len(r.path)) for r in url_filter.apply_rules(spark, df, rules).collect())
    assert got == [(1, "block", 200_004)] * 3 + [(2, "allow", 0)] * 2


def test_mix_replaces_columns_of_its_names(spark):
    rows = [(k, f"s{k % 3}", 10 + k, "a", "b", 5, 6, "keep") for k in range(60)] + [(None, "s0", 7, "a", "b", 5, 6, "keep")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, target string, source_size string, taken int, size int, _key string")
    got = mixing.mix(df, F.col("n"))
    assert got.columns == ["doc_id", "source", "n", "_key", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == 62 and all(r["size"] == r.n and r["_key"] == "keep" for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(taken == int(target) for taken, target in by.values())


@pytest.mark.parametrize("few", [0, 100_000])
def test_mix_without_broadcasts(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", few)
    monkeypatch.setattr(mixing, "PER_RANGE", 4)
    df = spark.createDataFrame([(k, None if k % 5 == 0 else f"s{k % 3}", k % 11) for k in range(200)], "doc_id long, source string, n long")
    rows = mixing.mix(df, F.col("n")).collect()
    assert len(rows) == 200 and sum(r.taken for r in rows) == pytest.approx(sum(r.n for r in rows), abs=4)


def test_formatted_length_counts_escapes(spark, tmp_path, compare):
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate([t for t in TRIALS if t is not None])] + [(2, 0, "<|says|>", "<| and <\\\\|"), (3, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(chat.OP3_SQL).fetchall()}
    got = {r.conv_id: tuple(r)[1:] for r in chat.op3_chat_format(spark, str(tmp_path)).collect()}
    assert got == want


def test_rules_leave_working_columns_alone(spark):
    pages = spark.createDataFrame([("https://a.example.com/en/x", 1, 2)], "url string, _best int, _row int")
    rules = spark.createDataFrame([("example.com", "/en/", "block")], "host string, path string, verdict string")
    r = url_filter.apply_rules(spark, pages, rules).first()
    assert (r._best, r._row, r.verdict) == (1, 2, "block")
    assert url_filter.apply_rules(spark, pages, rules.limit(0)).first()._best == 1


def test_documents_without_an_id_have_keys_of_their_own(spark):
    import corpus_pipeline

    d = spark.createDataFrame([(None, f"text number {k} of many", "s") for k in range(40)] + [(k, f"with id {k}", "s") for k in range(10)], "doc_id long, text string, source string")
    corpus_pipeline.mix(spark, d, "").count()
    sized = d.withColumn("_name", F.coalesce(F.col("doc_id").cast("string"), F.md5("text")))
    assert sized.select("_name").distinct().count() == 50
