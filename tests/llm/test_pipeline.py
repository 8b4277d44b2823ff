from pyspark.sql import functions as F

import corpus_pipeline
from citewell.llm import mixing, pieces, quality
from citewell.llm.common import made


def test_stages_on_a_small_table(docs, spark, tmp_path):
    clean = [" ".join(f"word{k}x{j}" for j in range(60)) for k in range(20)]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s0"), (101, "too short", "en", "s1"), (102, "### " * 40, "en", "s1")]
    rows += [(103, " ".join(f"other{j}" for j in range(50)) + " password=Zx81Kq7Lm2Pw9 end", "en", "s2")]
    df = docs(rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        if name != "piece_encoding":
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        df = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = lambda n: sorted({r.doc_id for r in seen[n].collect()})
    assert ids("quality_rules") == [*range(20), 100, 103]
    assert ids("near_duplicates") == [*range(20), 103]
    texts = {r.doc_id: r.text for r in seen["secret_scan"].collect()}
    assert texts[103].endswith("[SECRET] end") and all(texts[k] == clean[k] for k in range(20))
    words = seen["source_mix"].groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"))
    target = mixing.targets(mixing.sizes(seen["secret_scan"])).select("source", "target")
    assert all(r.n == round(r.target) for r in words.join(target, "source").collect())
    assert seen["piece_encoding"].count() == seen["source_mix"].count()
    assert quality.filter_documents(seen["source_mix"]).count() > 0
    assert pieces.digest(seen["source_mix"]).exceptAll(seen["piece_encoding"]).isEmpty()


def test_run_reads_documents(docs, spark, tmp_path):
    docs([(k, " ".join(f"t{k}y{j}" for j in range(30)), "en", "s") for k in range(6)]).write.parquet(str(tmp_path / "documents.parquet"))
    before = made()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 6
    (left,) = made() - before
    assert "/pipeline-source_mix-" in left
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_table(docs, spark, tmp_path):
    docs([(1, "x")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names(odd, spark):
    names = ("row_id", "epochs", "cut", "cut_key", "key", "size", "fp", "component_id", "_row", "_id", "_key", "_live", "n_words", "a.b")
    df = odd.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        assert out.where("size <> 5 OR `a.b` <> 13 OR _row <> 8").isEmpty(), name


def test_odd_rows(odd, spark):
    """What each stage says of nulls, repeated rows, very long texts and ties."""
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        assert name == "piece_encoding" or out.columns == odd.columns, name
        seen[name] = out.collect()
    assert all(r.text and len(r.text.split()) >= 10 for r in seen["quality_rules"])
    near = [(r.doc_id, r.text) for r in seen["near_duplicates"]]
    assert near.count((4, "a b c")) == 1 and (None, "no id") in near and (1, None) in near and not any(i == 7 for i, _ in near)
    assert sorted(map(repr, seen["secret_scan"])) == sorted(map(repr, odd.collect()))
    assert {r.doc_id for r in seen["source_mix"]} <= {r.doc_id for r in odd.collect()}
    assert len(seen["piece_encoding"]) == odd.count()


def test_ids_that_many_rows_share(docs, spark):
    """A third of the rows with one id, or none: near_duplicates keeps one of each text group."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None if k % 2 else 5, text(k)) for k in range(40)] + [(k + 100, text(k % 40)) for k in range(60)]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect()]
    assert sorted(t for _, t in kept) == sorted({t for _, t in rows})
