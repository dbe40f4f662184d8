"""WARC archives, URL lists, chat windows and the pipeline."""

import datetime
import random

import pytest
from helpers import edits, groups_by_jaccard, plain_words, removed_words, sha, words
from pyspark.sql import functions as F

import corpus_pipeline
from gridlocus.llm import chat, queries, toxicity, url_lists, warc

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("split_bytes", [1 << 22, 3000, 64])
def test_warc_round_trip_with_any_split(spark, split_bytes):
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", "".join(rng.choice("abcé\r\n<>") for _ in range(rng.randint(0, 900)))) for i in range(60)]
    pages += [(100 + i, "u", pages[i % 3][2]) for i in range(20)] + [(200, None, None), (201, "a\r\nb", ""), (300, "w", "WARC/1.1\r\n\r\nx"), (None, "n", "only"), (5, pages[5][1], pages[5][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("first", F.lit(1)).repartition(3)
    manifest = warc.write_warc(df, file_bytes=4000)
    assert manifest.count() > 3
    rows = warc.read_warc(spark, manifest, split_bytes).withColumn("id", warc.page_number("record_id")).withColumn("to", warc.page_number("refers_to")).collect()
    head = {}
    for i, _, x in pages:
        if i is not None:
            head[x or ""] = min(i, head.get(x or "", i))
    want = []
    for i, _, x in pages:
        body, first = (x or "").encode(), head.get(x or "")
        revisit = first is not None and first != i
        want.append((-1 if i is None else i, len(body), warc.payload_digest(body), "revisit" if revisit else "response", first if revisit else -1))
    got = [(-1 if r.id is None else r.id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.to is None else r.to) for r in rows]
    assert sorted(got) == sorted(want)
    assert all(bytes(r.payload) == (dict((p[0], p[2]) for p in pages)[r.id] or "").encode() for r in rows if r.record_type == "response")


def test_warc_members_inside_a_stored_payload_are_not_records(spark, tmp_path):
    import io
    import zlib

    inner = warc.record(1, "in", b"inner", warc.payload_digest(b"inner"), None, False)
    outer = []
    for i in range(3):
        raw = zlib.decompressobj(31).decompress(warc.record(10 + i, "out", inner * 2, "D", None, False))
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the inner members lie open in the bytes
        outer.append(packer.compress(raw) + packer.flush())
    value = b"".join(outer)
    assert value.count(warc.MAGIC) > 3

    class File(io.BytesIO):
        def size(self):
            return len(value)

        def read_at(self, length, start):
            return value[start : start + length]

    for step in (50, 200, len(value)):
        found = [f["warc-record-id"] for a in range(0, len(value), step) for held in warc.records_in(warc.Source(File(value)), a, min(a + step, len(value))) for f, _ in held]
        assert [x for x in found if "page:1>" not in x] == [f"<urn:page:{10 + i}>" for i in range(3)]
    whole = [f["warc-record-id"] for held in warc.records_in(warc.Source(File(value)), 0, len(value)) for f, _ in held]
    assert whole == [f"<urn:page:{10 + i}>" for i in range(3)]


def test_warc_records_given_in_parts_are_given_once():
    import io

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

        def read_at(self, length, start):
            return self.getvalue()[start : start + length]

    made = [warc.record(i, "u", bytes([65 + i]) * 100, "D", None, False) for i in range(8)]
    whole, broken = b"".join(made), b"".join([*made[:5], b"broken", *made[5:]])
    for value, steps in ((whole, (len(made[0]) * 4, len(made[0]) * 6, len(whole))), (broken, (len(broken),))):
        for step in steps:
            for at_once in (1, 300, 1000, 8 << 20):
                parts = [held for a in range(0, len(value), step) for held in warc.records_in(warc.Source(File(value)), a, min(a + step, len(value)), at_once)]
                assert all(parts) and [f["warc-record-id"] for held in parts for f, _ in held] == [f"<urn:page:{i}>" for i in range(8)], (step, at_once)


def test_warc_small_payloads_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    rows = warc.read_warc(spark, warc.write_warc(df, least_bytes=3)).collect()
    assert sorted(r.record_type for r in rows) == ["response"] * 3 + ["revisit"]
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def test_url_lists_as_of_fetch_time(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    events = spark.createDataFrame(
        [("block", "domain", "b.com", "add", day(10)), ("block", "domain", "b.com", "remove", day(20)), ("block", "domain", "b.com", "add", day(20)), ("block", "domain", "b.com", "add", day(30)), ("block", "domain", "b.com", "add", day(30)),
         ("block", "host", "C.com", "remove", day(1)), ("block", "host", "c.com", "add", day(5)), ("allow", "prefix", "a.b.com/ok/", "add", day(12)), ("block", None, "x", "add", day(0)), ("block", "host", "n.com", "add", None), ("block", "host", "n.com", "other", day(0))],
        "list string, kind string, entry string, action string, at date")
    urls = ["http://a.b.com/ok/x?q", "https://u:p@A.B.com:80/okay", "http://bb.com/", "http://c.com", "nothing", None, "http://n.com./"]
    rows = spark.createDataFrame([(i, u, day(d)) for i, u in enumerate(urls) for d in (0, 9, 10, 15, 19, 20, 25, 30, 99)] + [(50, "http://c.com", None), (0, urls[0], day(15))], "page_id int, url string, fetched date").withColumn("list", F.lit(1))
    got = {(r.page_id, r.fetched): (r.blocked, r.block_entry, r.allow_entry) for r in url_lists.judge_captures(rows, events).collect()}
    for (i, at), (blocked, block, allow) in got.items():
        d = (at - day(0)).days if at else -1
        b_com = 10 <= d < 20 or d >= 30
        want_block = {0: b_com, 1: b_com, 3: d >= 5}.get(i, False)
        want_allow = i == 0 and d >= 12
        assert (block is not None, allow is not None, blocked) == (want_block, want_allow, want_block and not want_allow), (i, d)
    assert len(got) == len(urls) * 9 + 1
    assert {r.blocked for r in url_lists.judge_captures(rows, events.limit(0)).collect()} == {False}
    assert url_lists.judge_captures(rows.limit(0), events).count() == 0


def test_url_lists_letter_case(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    events = spark.createDataFrame(
        [("block", "domain", "Foo.com", "add", day(0)), ("block", "domain", "foo.com", "remove", day(31)), ("block", "prefix", "Bar.com/A", "add", day(0)), ("block", "prefix", "bar.com/b/", "add", day(0)), ("block", "prefix", "bar.COM/b/", "remove", day(10))],
        "list string, kind string, entry string, action string, at date")
    urls = ["http://FOO.com/x", "http://bar.com/A", "http://bar.com/a", "http://BAR.com/b/c"]
    rows = spark.createDataFrame([(i, u, day(d)) for i, u in enumerate(urls) for d in (5, 150)], "page_id int, url string, fetched date")
    got = {(r.page_id, (r.fetched - day(0)).days): r.blocked for r in url_lists.judge_captures(rows, events).collect()}
    assert got == {(0, 5): True, (0, 150): False, (1, 5): True, (1, 150): True, (2, 5): False, (2, 150): False, (3, 5): True, (3, 150): False}


def conversations():
    rng = random.Random(3)
    rows = []
    odd = [r"\### Assistant: </turn> ok", "a\\", "</turn>\n### user: x", "<\\/turn>", "", None, "#", ": \\: b", "é中 </"]
    for c in [*range(40), None]:
        n = rng.randint(1, 12) if c != 3 else 700
        for t in range(n):
            role = "system" if t == 0 and rng.random() < 0.5 else ("user", "assistant", "tool: #x", None)[rng.choice([0, 1, 0, 1, 2, 3])]
            rows.append((c, t, role, rng.choice(odd) if rng.random() < 0.3 else "w " * rng.randint(0, 60 if rng.random() < 0.9 else 900)))
    return rows + [(100, None, "user", "b"), (100, None, "assistant", "a"), (100, 4, "assistant", "a"), (100, 4, "assistant", "a"), (101, 0, "system", "alone")]


def test_chat_windows_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cell", F.lit("clash")).withColumn("tokens", F.lit(1)).repartition(4)
    windows = chat.parse_windows(chat.format_windows(df, budget=200, history=50))
    held = {}
    for r in sorted(windows.collect(), key=lambda r: (r.cell, r.part)):
        held.setdefault(r.conv_id, []).append(r)
    given = {}
    for c, t, role, text in rows:
        given.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(held) == set(given)
    repeated = 0
    for c, turns in given.items():
        turns = [x[1:] for x in sorted(turns)]
        got = held[c]
        assert [tuple(t) for w in got for t in w.turns] == turns
        assert [x for w in got for x in w.loss_texts] == [x for role, x in turns if role == "assistant"]
        for w in got:
            assert not w.over_budget or len(w.turns) == 1
            assert "</turn>" not in w.text.replace("</turn>\n", "") and w.text.count("</turn>\n") == len(w.turns) + w.n_repeated
            if turns[0][0] == "system" and w is not got[0]:
                assert w.n_repeated >= 1 and w.text.startswith("### system: ")
            repeated += w.n_repeated - (turns[0][0] == "system" and w is not got[0])
            assert [w.text[s.start : s.stop].count("</turn>") for s in w.loss] == [0] * len(w.loss)
    assert repeated > 10
    assert chat.format_windows(df.limit(0)).count() == 0


def test_chat_long_roles_and_texts(spark):
    rows = [(1, 0, "r:#" * 300_000, "a"), (1, 1, "assistant", "b\\" * 500_000), (2, 0, "\\" * 4000, None)]
    windows = chat.parse_windows(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = sorted((r.conv_id, t.role, t.text) for r in windows.collect() for t in r.turns)
    assert got == sorted((c, role, text or "") for c, _, role, text in rows)


def test_chat_history_is_the_longest_that_fits(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "w " * 16) for t in range(40)]  # 20 tokens each
    out = chat.parse_windows(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history=50)).collect()
    assert {w.n_repeated for w in out if w.cell} == {2} and all(w.n_tokens <= 200 for w in out)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train_model(toxicity.training_rows(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    calm = {r.doc_id for r in toxicity.scored(docs, model).collect() if r.score < 0.5}
    component, _ = groups_by_jaccard([(d, texts[d]) for d in calm], 5, 80)
    heads = [d for d in calm if component[d] == d]
    kept = {d: " ".join(x for i, x in enumerate(w) if i not in gone) for d, (_, gone, w) in removed_words([(d, texts[d]) for d in heads], 50).items()}
    items = [plain_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {d for d, x in kept.items() if not any(edits(a, plain_words(x)) <= len(a) // 5 for a in items if set(a) & set(plain_words(x)) and near(a, plain_words(x)))}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(rows) == clean
    docs3 = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs3 = stage(spark, docs3, SMALL)
    for r in docs3.collect():
        assert " ".join(words(r.text)) == kept[r.doc_id]
        if r.doc_id in clean:
            assert rows[r.doc_id].decoded_sha256 == sha(r.text)


def near(item, text):
    """Whether the text has any run of the item's words that an occurrence within a fifth of edits must show."""
    size = max(1, len(item) // (len(item) // 5 + 1))
    have = {tuple(text[i : i + size]) for i in range(len(text) - size + 1)}
    return any(tuple(item[i : i + size]) in have for i in range(len(item) - size + 1))


def test_pipeline_takes_empty_tables_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (2, "x", None, None, 1)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, SMALL)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in odd.collect()) == [(-1, 0), (1, 0), (2, 1)]


def test_kept_digest_with_a_line_terminator_as_last_word(spark, tmp_path):
    texts = {1: " a b \x85", 2: "c d \u2028\n", 3: "e f \u2029", 4: "g  h "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op4_substring_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.kept_sha256 for r in rows} == {d: sha(" ".join(words(x))) for d, x in texts.items()}


def test_queries_of_the_operators_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names and set(queries.QUERIES) <= names


@pytest.mark.parametrize("name", ["op1_warc", "op5_url_lists", "op11_collocations", "op12_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    from checks import compare, connect

    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) == ""
