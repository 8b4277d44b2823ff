"""The prefix trie against one made by loops over whole sequences."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from citewell.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(xs, key=lambda x: x[:2])] for c, xs in by.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members, kids, value = defaultdict(list), defaultdict(list), {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        value[k] = (sum(value[x][0] for x in kids[k]) or 1, saved + sum(value[x][1] for x in kids[k]))
    ends = lambda k: ",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k))))
    return sorted(
        (
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *value[k], hashlib.sha256(ends(k).encode()).hexdigest())
            for k, m in members.items()
        ),
        key=str,
    )


def found(spark, rows, schema=SCHEMA):
    turns = trie.ordered_turns(spark.createDataFrame(rows, schema))
    return sorted(map(tuple, trie.prefix_trie(*trie.rebuilt(turns)).collect()), key=str)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in range(-6, 60):
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 3, 20, 40])):
            conv = None if rng.random() < 0.02 else c
            turn = rng.choice([t, t, None, t // 2]) if rng.random() < 0.1 else t
            role = rng.choice(["u", "a", None]) if rng.random() < 0.1 else "ua"[t % 2]
            rows.append((conv, turn, role, rng.choice(["x", "", None, "é"]) if rng.random() < 0.2 else f"t{t}"))
    assert found(spark, rows) == plain_trie(rows)


def test_copies_single_and_turnless_conversations(spark):
    copies = [(c, t, "u", f"h{t}") for c in range(600) for t in range(3)]  # more ids than a piece of a list
    assert found(spark, copies) == plain_trie(copies)
    turnless = [(c, 0, None, "x") for c in (3, 7, 8)]  # no base: own turns after the first h
    assert found(spark, turnless) == plain_trie(turnless)
    repeated = [(5, 0, "u", "x")] * 3 + [(6, None, None, None)]
    assert found(spark, repeated) == plain_trie(repeated)


def test_deep_common_prefix_goes_over_strides(spark):
    rows = [(c, t, "u", f"h{t}") for c in (0, 5, 10) for t in range(20 + c)]
    assert found(spark, rows) == plain_trie(rows)


def test_nothing_and_ids_missing(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []


def test_query_takes_further_columns(spark, tmp_path):
    rows = [(c, t, "u", f"{t}{c % 3}") for c in range(12) for t in range(4)]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", key string, place int")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(map(tuple, trie.op12_trie(spark, str(tmp_path)).collect()), key=str) == plain_trie(rows)
