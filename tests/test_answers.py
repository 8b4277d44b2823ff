from pyspark.sql import functions as F

from citewell import queries
from citewell.config import Settings
from citewell.operators import chunking, enforce, generate, sections, sessions
from citewell.operators.store import Store
from citewell.plans import answer, evaluate, ingest
from citewell.sources import tables

S = Settings(dimensions=64, min_similarity=0.05, top_k=4)


def pages(spark):
    section = lambda t, x: (t, 2, x, False, 0)
    rows = [
        ("large", "Large Scheme", "c", "p", "https://p.example/large", "m", [section("Fees", "The expense ratio is 1.04% here. An exit load of 1% applies."), section("Managers", "Asha Rao manages the portfolio since May. Ben Iyer helps.")]),
        ("small", "Small Scheme", "c", "p", "https://p.example/small", "m", [section("Fees", "The expense ratio is 0.75% here. No exit load applies."), section("Lock", "The lock-in period is 3 years long. Units stay locked.")]),
    ]
    return spark.createDataFrame(
        rows,
        "scheme_id string, scheme_name string, category string, plan string, final_url string, extraction_mode string, "
        "sections array<struct<section_title:string,heading_level:int,text:string,is_table:boolean,order:int>>",
    )


def world(spark):
    docs = sections.build_documents(pages(spark), F.lit("2026-01-31"))
    chunks = ingest.embedded(chunking.chunk_documents(docs, Settings(min_section_tokens=1)), s=S)
    aliases = spark.createDataFrame([("large", "large"), ("small", "small")], "scheme_id string, alias string")
    manifest = spark.createDataFrame(
        [("large", "Large Scheme", "https://p.example/large"), ("small", "Small Scheme", "https://p.example/small")],
        "scheme_id string, scheme_name string, url string",
    )
    return chunks, manifest, aliases


def test_batch_of_questions(spark):
    chunks, manifest, aliases = world(spark)
    asked = ["What is the expense ratio of the small one?", "Should I buy it?", "Mail me at a.b@c.example", "What is the CAGR of large?", "zzz qqq", "lock-in period?"]
    rows = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string")
    got = {r.query_id: r for r in answer.answer(rows, chunks, manifest, aliases, S).collect()}
    assert [got[k].kind for k in range(6)] == ["factual", "refusal", "refusal", "refusal", "not_found", "factual"]
    assert "0.75%" in got[0].text and got[0].citations[0].url == "https://p.example/small"
    assert got[1].citations[0].url == answer.EDUCATION_URL and got[2].citations == []
    assert got[3].citations[0].url == "https://p.example/large" and got[3].citations[0].scheme_name == "Large Scheme"
    assert "a.b@c.example" not in str(got[2])
    assert all(r.text.endswith("Last updated from sources: 2026-01-31") for r in got.values())
    assert "3 years" in got[5].text
    again = answer.answer(rows, chunks, manifest, aliases, S)
    payload = [r[0] for r in again.select(tables.answer_payload()).collect()]
    assert all('"query' not in p and '"kind"' in p for p in payload)
    assert all("── [" in r[0] for r in again.select(tables.print_record(F.lit(1))).collect())
    turns = sessions.record(again.withColumn("session_id", F.lit("s")).withColumn("seq", F.col("query_id")))
    assert turns.count() == 6


def test_refusals_work_on_an_empty_corpus(spark):
    chunks, manifest, aliases = world(spark)
    rows = spark.createDataFrame([(1, "Should I buy it?"), (2, "What is the load?")], "query_id bigint, query string")
    got = {r.query_id: r for r in answer.answer(rows, chunks.limit(0), manifest, aliases, S).collect()}
    assert (got[1].kind, got[2].kind, got[2].actions, got[2].recorded) == ("refusal", "error", ["corpus_empty"], False)


def test_a_model_is_used_if_given_and_falls_back(spark):
    chunks, manifest, aliases = world(spark)
    rows = spark.createDataFrame([(1, "expense ratio of small?"), (2, "lock-in period of small?")], "query_id bigint, query string")

    def client():
        def call(messages):
            if "lock-in" in messages[-1]["content"].rsplit("Question:", 1)[1]:
                raise OSError("down")
            return "Certainly! The expense ratio is 0.75%, not 9.99%. [1]"

        return call

    s = Settings(dimensions=64, min_similarity=0.05, top_k=4, llm_model="m")
    got = {r.query_id: r for r in answer.answer(rows, chunks, manifest, aliases, s, client=client).collect()}
    assert got[1].generation_mode == generate.LLM and "9.99" not in got[1].text and got[1].prompt_chars > 0
    assert got[2].generation_mode == generate.EXTRACTIVE


def test_enforced_texts(spark):
    rows = {r.query_id: r for r in queries.enforce_cases(spark, "").collect()}
    for k, (_, kind, out, acts) in enumerate(queries.ENFORCED):
        assert (rows[k].kind, rows[k].actions) == (kind, acts)
        assert rows[k].text == (enforce.NOT_FOUND_TEXT if out is None else out) + queries.STAMP


def test_enforce_takes_anything(spark):
    hostile = ["", "   ", "\n\n", queries.URL1, "?", ".", "₹", "5", "x" * 20000, "Source:", "[[]](())", "😀 " * 50, "[99] [1]", None]
    rows = spark.createDataFrame(list(enumerate(hostile)), "query_id int, raw string")
    chunk = F.struct(F.lit("A fee of 1%.").alias("text"), F.lit("s").alias("section"), F.lit("n").alias("scheme_name"), F.lit(queries.URL1).alias("source_url"))
    for chunks in (F.array(chunk), F.array().cast("array<struct<text:string,section:string,scheme_name:string,source_url:string>>")):
        done = enforce.enforce(rows.withColumn("chunks", chunks).withColumn("max_fetched_at", F.lit(None).cast("string"))).collect()
        assert len(done) == len(hostile) and all(r.text.endswith("unknown") for r in done)
        assert all(len(r.citations) == (r.kind == "factual") for r in done)


def test_failed_batches_tell_where_but_not_what(spark):
    rows = spark.createDataFrame([(1, "a@b.example?")], "query_id bigint, query string")
    try:
        raise KeyError("secret words")
    except KeyError as e:
        (r,) = answer.failed(rows, e).collect()
    assert r.kind == "error" and r.actions[0] == "pipeline_error:KeyError" and "secret" not in str(r.actions)


def test_store(spark, tmp_path):
    chunks, _, _ = world(spark)
    store = Store(spark, str(tmp_path / "store"))
    assert store.read() is None
    assert store.write(chunks, "chunk_index") and store.read().count() == chunks.count()
    assert not store.write(chunks.limit(0)) and store.read().count() == chunks.count()
    assert store.write(chunks.where("scheme_id = 'small'"), "chunk_index")
    assert {r.scheme_id for r in store.read().collect()} == {"small"}
    assert store.write(chunks.limit(0), force=True) and store.read().isEmpty()


def test_store_survives_a_crash_between_any_two_steps(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda n: spark.createDataFrame([(f"c{k}", k) for k in range(n)], "chunk_id string, chunk_index int")
    assert store.current() is None and store.vacuum() == []
    store.stage(rows(9))  # a crash before the first commit: there is no store yet
    assert store.current() is None and store.read() is None
    store.write(rows(1))
    first, opened = store.current(), store.read()
    half = store.stage(rows(2))  # a crash after the rows are written
    assert store.current() == first and store.read().count() == 1
    (tmp_path / "store" / "v-000000000099-torn").mkdir()  # or while they were
    assert store.current() == first
    store.write(rows(3))
    assert store.read().count() == 3 and opened.count() == 1  # the reader of the old version keeps its files
    assert store.read(first).count() == 1
    store.write(rows(4))
    gone = store.vacuum(keep=1)
    assert first in gone and half in gone and store.read().count() == 4 and store.versions() == [store.current()]


def test_fingerprint_streams_the_ids_in_order(spark):
    import hashlib

    from citewell.operators.store import corpus_fingerprint, set_fingerprint

    ids = ["b", "a", "é", "a", "10", "9", None]
    df = spark.createDataFrame([(i,) for i in ids], "chunk_id string")
    want = hashlib.sha256("".join(sorted(i for i in ids if i)).encode()).hexdigest()[:12]
    assert [r[0] for r in corpus_fingerprint(df.repartition(3)).collect()] == [want]
    assert [r[0] for r in corpus_fingerprint(df.limit(0)).collect()] == [""] == [r[0] for r in corpus_fingerprint(df.where("chunk_id IS NULL")).collect()]
    assert set_fingerprint(df).first()[0] == set_fingerprint(df.repartition(4)).first()[0]


def test_tables(spark, tmp_path):
    good = tmp_path / "s.csv"
    good.write_text("scheme_id,scheme_name,category,plan,url\n a , A,c,p,https://u\n,,,,\nb,B,c,p,https://v\n")
    assert [tuple(r) for r in tables.read_sources(spark, str(good)).collect()] == [("a", "A", "c", "p", "https://u"), ("b", "B", "c", "p", "https://v")]
    bad = tmp_path / "bad.csv"
    bad.write_text("scheme_id,scheme_name,category,plan,url\na,A,c,p,\n")
    for path, words in ((bad, "line 2: empty field(s): url"),):
        try:
            tables.read_sources(spark, str(path))
        except Exception as e:  # noqa: BLE001
            assert words in str(e)
        else:
            raise AssertionError("no error")
    none = tmp_path / "none.csv"
    none.write_text("scheme_id,url\na,u\na,v\n,w\n")
    try:
        tables.read_sources(spark, str(none))
    except Exception as e:  # noqa: BLE001
        assert "scheme_name" in str(e)
    assert tables.source_index(spark, str(tmp_path / "missing.csv")).isEmpty()
    index = tmp_path / "i.csv"
    index.write_text("scheme_id,scheme_name,url\na,A,u\na,A2,v\n,x,w\n")
    assert [tuple(r) for r in tables.source_index(spark, str(index)).collect()] == [("a", "A2", "v")]
    assert tables.load_documents(spark, str(tmp_path / "no.jsonl")).isEmpty()
    chunks, _, _ = world(spark)
    tables.write_json(chunks.drop("embedding", "body_embedding"), str(tmp_path / "c.jsonl"), ("chunk_id",))
    assert tables.load_chunks(spark, str(tmp_path / "c.jsonl")).count() == chunks.count()
    q = tmp_path / "q.txt"
    q.write_text("one\n\n two \nEXIT\nthree\n")
    assert [r.query for r in tables.read_questions(spark, str(q)).orderBy("query_id").collect()] == ["one", "two"]
    a = tmp_path / "a.json"
    a.write_text('{"x": ["One", "TWO"], "y": []}')
    assert sorted(tuple(r) for r in tables.read_aliases(spark, str(a)).collect()) == [("x", "one"), ("x", "two")]


def test_ingest_of_pages(spark):
    html = "<main><h1>T</h1><p>" + "Fact 5% stands here. " * 40 + "</p></main>"
    got = spark.createDataFrame(
        [("a", "u", "u2", html, 200, None), ("b", "v", None, None, None, "HTTP 500"), ("c", "w", "w", "<p>tiny</p>", 200, None)],
        "scheme_id string, url string, final_url string, html string, status int, error string",
    )
    manifest = spark.createDataFrame([(k, k.upper(), "c", "p", "u") for k in "abc"], "scheme_id string, scheme_name string, category string, plan string, url string")
    docs, failed = ingest.documents_of(got, manifest, fetched_at=F.lit("2026-01-31"))
    assert [(r.scheme_id, r.source_url, r.scheme_name) for r in docs.collect()] == [("a", "u2", "A")]
    assert {r.scheme_id for r in failed.collect()} == {"b", "c"}
    (one,) = ingest.report(docs, failed, got).collect()
    assert (one.sources_ok, one.sources_failed, one.max_fetched_at) == (1, ["b", "c"], "2026-01-31")
    assert "a: redirected u -> u2" in one.warnings


def test_gates_and_markdown(spark):
    table = queries.eval_gates(spark, "")
    assert "| AC8 | 0 | 5 | NO |" in evaluate.markdown(table)


def test_last_turns_of_none(spark):
    rows = spark.createDataFrame([("s", k) for k in range(5)], "session_id string, seq int")
    assert sessions.last_turns(rows, 0).isEmpty()
    assert sorted(r.seq for r in sessions.last_turns(rows, 3).collect()) == [2, 3, 4]
