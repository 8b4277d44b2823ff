from pyspark.sql import functions as F

from citewell import queries
from citewell.functions import guard


def classified(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    return [r.g for r in df.select(guard.classify("q").alias("g")).collect()]


def test_golden(spark):
    found = classified(spark, *(q for q, _, _ in queries.GOLDEN))
    assert [(g.action, g.matched_pattern) for g in found] == [(a, p) for _, a, p in queries.GOLDEN]


def test_personal_data_comes_first_and_is_redacted(spark):
    (g,) = classified(spark, "Should I buy? My PAN is ABCDE1234F, CAGR?")
    assert (g.action, g.matched_pattern) == ("refuse_pii", "PAN")
    assert "ABCDE1234F" not in g.redacted_query


def test_advice_before_performance(spark):
    (g,) = classified(spark, "Should I buy for the CAGR?")
    assert g.action == "refuse_advice"


def test_empty_and_null(spark):
    assert [(g.reason, g.redacted_query) for g in classified(spark, None, "", " ")] == [("empty_query", ""), ("empty_query", ""), ("empty_query", " ")]


def test_hostile_texts_get_an_action(spark):
    texts = ["?" * 5000, "a" * 20000, "1" * 9000, "\x00", "😀" * 100, "[[[(((", "+91" * 500]
    assert all(g.action for g in classified(spark, *texts))


def test_matches_leave_out_overlaps(spark):
    df = spark.createDataFrame([("call 2345 6789 0123 or a.b@c.example",)], "q string")
    (m,) = (r.m for r in df.select(guard.pii_matches("q").alias("m")).collect())
    assert [(x.kind, x.value) for x in m] == [("AADHAAR", "2345 6789 0123"), ("EMAIL", "a.b@c.example")]


def test_one_scan_finds_what_the_rules_find(spark):
    """The guard skips rules that can't fit; they must say the same where all are run."""
    import random

    rng = random.Random(5)
    parts = ["should", "i", "Best", "fund", " ", " ", "\t", "12", "345", "2345 6789 0123", "a@b.c", "@", "ABCDE1234F", "otp", "is", "4829", "cagr", "3 year return", "ſhould i", ".", "returns", "of", " ", "٣٤٥"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 9)))) for k in range(500)] + [(500, None)]
    df = spark.createDataFrame(rows, "k int, q string")
    text = F.coalesce("q", F.lit(""))
    redacted = text
    for kind, pattern in guard.PII:
        redacted = F.regexp_replace(redacted, pattern, f"[REDACTED:{kind}]")
    whole = F.coalesce(guard.first_of(text, guard.PII, ""), guard.first_of(redacted, guard.ADVICE), guard.first_of(redacted, guard.PERFORMANCE))
    got = df.select("q", guard.classify("q").alias("g"), redacted.alias("r"), whole.alias("m")).collect()
    assert [r for r in got if (r.g.redacted_query, r.g.matched_pattern) != (r.r, r.m)] == [] and len({r.m for r in got}) > 6


def test_unsearched_questions_are_classified_once(spark):
    from citewell.plans import answer

    rows = spark.createDataFrame([(1, "Should I buy?"), (2, "the fee"), (3, "cagr of large cap")], "query_id int, query string")
    aliases = spark.createDataFrame([("l", "large cap")], "scheme_id string, alias string")
    manifest = spark.createDataFrame([("l", "Large", "https://x/l")], "scheme_id string, scheme_name string, url string")
    g = answer.guarded(rows, aliases).withColumns({"max_fetched_at": F.lit("d"), "corpus_fingerprint": F.lit("f"), "max_similarity": F.lit(0.0)})
    done = answer.unsearched(g, manifest)
    got = {r.query_id: r for r in done.collect()}
    assert [got[k].kind for k in (1, 2, 3)] == ["refusal", "not_found", "refusal"] and got[3].citations[0].scheme_name == "Large"
    two = answer.refusals(g, manifest).unionByName(answer.not_found(g.where("guard.action = 'answer'"), manifest))
    hidden = F.col("guard").withField("redacted_query", F.lit(None).cast("string"))
    assert sorted(two.withColumn("guard", hidden).collect()) == sorted(done.collect())
    assert done._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [query_id") == 1
    plan = done._jdf.queryExecution().executedPlan().toString()
    # Rows that name no scheme would all meet in one task of a shuffle.
    assert "SortMergeJoin" not in plan
