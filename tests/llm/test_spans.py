import hashlib
import random
import re

from pyspark.sql import functions as F

from citewell.llm import pii, secrets

BASE_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain_pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE_PII.items() for m in re.finditer(p, text) if valid(k, m[0])]


def plain_secrets(text):
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def test_pii_base_against_loops(docs):
    rng = random.Random(7)
    parts = ["a@b.c", "x.y@", "@", "_d@e.f", ".", "-", " ", "+", "(", ")", "1", "22", "255", "256", "4111 1111 1111 1111", "4111111111111111", "é", "😀", "\n", "00000001", "a"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 16))) for _ in range(2500)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (988) 555-2485", "4111-1111-1111-1111x5500 0000 0000 0004", "a" * 50000 + "@b.c", "1" * 50000, "a@" + "b." * 20000 + "c", "1 " * 20000]
    out = pii.personal_data(docs(list(enumerate(texts))))
    got = {r.doc_id: r.s for r in out.select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    wrong = [(t, got[k], plain_pii(t)) for k, t in enumerate(texts) if got[k] != ",".join(plain_pii(t))]
    assert wrong == []


def test_secrets_base_against_loops(docs):
    rng = random.Random(8)
    parts = ["token", "Secret", "api_key", "APIKEY", "password", "=", ":", " ", '"', "'", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "ABCDEF", "xyz", "é", "\n", ".", "ſ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(2500)]
    texts += ["token=password=abcdefghijklmnop", "token: secret: abcdefghijklmnop", "AKIAAKIA" + "A" * 20, "a" * 60000, "token" + " " * 50000 + "= x"]
    out = secrets.secrets(docs(list(enumerate(texts))))
    got = {r.doc_id: r.s for r in out.select("doc_id", secrets.listed(F.col("base")).alias("s")).collect()}
    wrong = [(t, got[k], plain_secrets(t)) for k, t in enumerate(texts) if got[k] != ",".join(plain_secrets(t))]
    assert wrong == []


def test_contexts_find_unseen_identifiers_and_leave_others(docs):
    rows = [(k, f"please write to member u{k}.x@mail.example today") for k in range(12)]
    rows += [(100 + k, f"please write to member MX-48{k}71-Q today") for k in range(2)]
    rows += [(200 + k, f"the serial number was SN-48{k}71 there") for k in range(12)]
    out = pii.personal_data(docs(rows))
    more = {r.doc_id: r.more for r in out.collect()}
    assert all(len(more[100 + k]) == 1 for k in range(2))
    assert [s.kind for s in more[100]] == ["like_email"]
    text = dict(rows)[100]
    assert text[more[100][0].start : more[100][0].end] == "MX-48071-Q"
    assert all(not more[k] for k in more if k < 100 or k >= 200)


def test_contexts_after_and_labels(docs):
    """The words after an identifier, and a label before it, are patterns as well."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = [(k, f"{word()} u{k}.x@mail.example belongs to {word()}") for k in range(12)]
    rows += [(100 + k, f"{word()} ID-48{k}71 belongs to {word()}") for k in range(3)]
    rows += [(200 + k, f"{word()} {word()} host= 10.0.{k}.1 {word()} {word()}") for k in range(12)]
    rows += [(300 + k, f"{word()} {word()} Host= srv{k}0077 {word()} {word()}") for k in range(3)]
    more = {r.doc_id: [(s.kind, dict(rows)[r.doc_id][s.start : s.end]) for s in r.more] for r in pii.personal_data(docs(rows)).collect()}
    assert all(more[100 + k] == [("like_email", f"ID-48{k}71")] and more[300 + k] == [("like_ip", f"srv{k}0077")] for k in range(3))
    assert not any(more[k] for k in more if k < 100 or 200 <= k < 300)


def test_found_instances_support_new_patterns(docs):
    """A second pattern has no seed: its instances are those that the first one found."""
    rows = [(k, f"write to member u{k}.x@mail.example today") for k in range(40)]
    rows += [(100 + k, f"write to member M48{k}71 today") for k in range(8)] + [(200 + k, f"ledger row of M48{k}71 closed") for k in range(8)]
    rows += [(300 + k, f"ledger row of K99{k}55 closed") for k in range(1)]
    rows += [(400, "order number is N777888 there")]
    long = "Z" * 5000 + "123456"
    rows += [(500, f"write to member {long} today")]
    more = {r.doc_id: [dict(rows)[r.doc_id][s.start : s.end] for s in r.more] for r in pii.personal_data(docs(rows)).collect()}
    assert all(more[300 + k] == [f"K99{k}55"] for k in range(1)) and not more[400] and more[500] == [long]


def plain_bootstrap(edges, support=pii.SUPPORT, confidence=pii.CONFIDENCE):
    """Loops over (pattern, instance, kind or None): trusted (pattern, kind) pairs."""
    size = {}
    for p, i, _ in edges:
        size.setdefault(p, set()).add(i)
    edges = [e for e in edges if len(size[e[0]]) >= support]
    seeds = {(i, k): 1.0 for _, i, k in edges if k}
    scores, scored = dict(seeds), None
    for _ in range(100):
        now = {}
        for p in {p for p, _, _ in edges}:
            for k in {k for _, k in scores}:
                own = [scores[i, k] for i in size[p] if (i, k) in scores]
                c = min(1.0, sum(own) / len(size[p]))
                if sum(x >= pii.SURE for x in own) >= support and c >= confidence:
                    now[p, k] = c
        moved = now.keys() != (scored or {}).keys() or any(abs(now[x] - scored[x]) > pii.SETTLED for x in now)
        scored = now
        if not moved:
            break
        errs = {}
        for p, i, k in edges:
            for (q, g), c in now.items():
                if k is None and q == p:
                    errs[i, g] = errs.get((i, g), 1.0) * (1 - pii.DAMPING * c)
        scores = seeds | {x: 1 - e for x, e in errs.items()}
    return set(scored)


def test_scoring_against_loops(spark):
    rng = random.Random(9)
    kinds = {f"i{k}": rng.choice([None, None, "email", "ip"]) for k in range(300)}
    edges = set()
    for p in range(60):
        own = rng.choice(["email", "ip", None])
        pool = [i for i, k in kinds.items() if own is None or k in (own, None)] if rng.random() < 0.7 else list(kinds)
        good = [i for i in pool if kinds[i] == own] or pool
        for i in {rng.choice(good if rng.random() < 0.85 else pool) for _ in range(rng.choice([3, 8, 20]))}:
            edges.add((f"p{p}", i, kinds[i]))
    sizes = {}
    for p, _, _ in edges:
        sizes[p] = sizes.get(p, 0) + 1
    rows = [(p, i, k, sizes[p]) for p, i, k in edges if sizes[p] >= pii.SUPPORT]
    df = spark.createDataFrame(rows, "pattern string, instance string, kind string, size bigint")
    got = {(r.pattern, r.kind) for r in pii.patterns(df).collect()}
    assert got == plain_bootstrap(edges) and len(got) > 5


def test_recall_and_precision_on_planted_identifiers(docs):
    """Unseen identifiers in the contexts of seeds, among as many harmless codes."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7)))
    before = ["reach me at", "my contact is", "account holder", "customer ref"]
    after = ["is my address", "was registered by", "signed the form"]
    plain = ["order number", "build", "see page", "model type", "invoice of"]
    rows, planted, harmless = [], {}, {}
    for k in range(900):
        text = lambda: " ".join(word() for _ in range(rng.randint(4, 9)))
        seed, unseen, code = f"u{k}@mail{k % 7}.example", f"ID{rng.randrange(10**8):08d}", f"C{rng.randrange(10**7):07d}x"
        what = seed if k % 7 else unseen
        context = f"{rng.choice(before)} {what} {text()}" if k % 2 else f"{text()} {what} {rng.choice(after)}"
        rows.append((k, f"{text()} {context} {text()} {rng.choice(plain)} {code} {text()}"))
        harmless[k] = code
        if not k % 7:
            planted[k] = unseen
    texts = dict(rows)
    found = {(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in pii.personal_data(docs(rows)).collect() for s in r.more}
    hits = found & set(planted.items())
    assert len(hits) / len(planted) >= RECALL and len(hits) / max(len(found), 1) >= 0.98, (len(hits), len(planted), len(found))


RECALL = 0.9


def test_ownership_separates_examples_from_live(docs, spark):
    shown, own, bare = "exampleKey1234567", "liveKey9876543210", "liveKey9876543210"
    rows = [(k, f"doc {k} has token={shown} in it", "en", f"s{k}") for k in range(5)]
    rows += [(10, f"here password: {own} ok", "en", "s1"), (11, f"and later ({bare}) again", "en", "s2"), (12, "nothing", "en", None)]
    df = docs(rows)
    got = {r.doc_id: r for r in secrets.secrets(df).collect()}
    assert all((got[k].n_example, got[k].n_live) == (1, 0) for k in range(5))
    assert (got[10].n_live, len(got[10].copies)) == (1, 0)
    assert [(s.kind, rows[6][1][s.start : s.end]) for s in got[11].copies] == [("copy", f"{bare}")] or len(got[11].copies) == 1
    out = {r.doc_id: r for r in secrets.redact_documents(df).collect()}
    assert out[10].text == "here [SECRET] ok" and own not in out[11].text and out[10].n_chars == len(out[10].text)
    assert all(out[k].text == rows[k][1] for k in range(5)) and out[12].text == "nothing"


def plain_words(value, at):
    """(start, end, low, high, text, what follows) of the words of a value."""
    front = len(re.match(r"[.=/+_-]*", value)[0])
    back = len(re.search(r"[.=/]*$", value)[0])
    if front == len(value):
        front = back = 0
    elif front + back > len(value):
        back = len(value) - front
    core, out = value[front : len(value) - back], []
    if front == back == 0 and not re.search("[A-Za-z0-9]", value):
        core = value
    gaps = [(m.start(), m.end()) for m in re.finditer(r"(?<!\.)\.*[=/][.=/+_-]*", core)]
    begin, low = 0, at
    for a, b in [*gaps, (len(core), len(core))]:
        start, end = at + front + begin, at + front + a
        high = at + len(value) if a == len(core) else at + front + b
        out.append((start, end, low, high, core[begin:a], core[a:b]))
        begin, low = b, end
    return out


def plain_copies(rows, examples=secrets.EXAMPLE_OWNERS):
    """From (doc_id, text, lang, source): verdicts by value, and copies by doc_id."""
    key = lambda ws: ("".join(w[4] + "\x00" + w[5] + "\x00" for w in ws[:-1]) + ws[-1][4])
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base, owners, live = {}, {}, {}
    for i, text, _, source in rows:
        spans = [(m.start(), m.end(), m[1]) for m in assign.finditer(text) if len(m[1]) >= 12]
        spans += [(m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]{14,}", text)]
        spans += [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]{16,}", text)]
        base[i] = spans
        for _, _, v in spans:
            k = key(plain_words(v, 0))
            owners.setdefault(k, set()).add(source)
            good = bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= secrets.LIVE_CHARS)
            live[k] = live.get(k, False) or good
            live["words", k] = len(plain_words(v, 0))
    verdict = {k: "example" if len(o) >= examples else "live" if live[k] else "weak" for k, o in owners.items()}
    sizes = {live["words", k] for k, v in verdict.items() if v == "live"}
    copies = {}
    for i, text, *_ in rows:
        found = set()
        for m in re.finditer(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12,}", text):
            ws = plain_words(m[0], m.start())
            for n in sizes:
                for k in range(len(ws) - n + 1):
                    run = ws[k : k + n]
                    may = any(re.search("[0-9]", w[4]) for w in run) and any(re.search("[A-Za-z]", w[4]) for w in run) and run[-1][3] - run[0][2] >= 12
                    a, b = run[0][0], run[-1][1]
                    if may and verdict.get(key(run)) == "live" and not any(x < b and a < y for x, y, _ in base[i]):
                        found.add((a, b))
        copies[i] = sorted(found)
    n = {i: tuple(sum(verdict[key(plain_words(v, 0))] == x for _, _, v in base[i]) for x in ("live", "example")) for i in base}
    return copies, n


def test_ownership_and_copies_against_loops(docs):
    rng = random.Random(21)
    values = ["".join(rng.choices("abcdef0123456789", k=rng.choice([16, 20]))) for _ in range(6)]
    values += ["".join(rng.choices("aB3/=+._-xY7", k=rng.randint(12, 18))) for _ in range(14)] + ["AKIA" + "".join(rng.choices("ABC123", k=16)) for _ in range(4)]
    noise = ["word", "x1", "(", ")", "path/to", "a=b", ".", "/", "=", "\n", "9"]
    rows = []
    for k in range(400):
        parts = []
        for _ in range(rng.randint(1, 6)):
            v = rng.choice(values)
            if rng.random() < 0.3:
                v += rng.choice(["==", ".", "/tail", "=end1"])
            parts.append(rng.choice([f"token={v}", f'password: "{v}"', v, f"dir/{v}", f"K={v}", rng.choice(noise), rng.choice(noise)]))
        rows.append((k, rng.choice([" ", " ", ", "]).join(parts), "en", rng.choice(["s1", "s2", None] if k % 5 else ["s3", "s4"])))
    want, counts = plain_copies(rows)
    got = {r.doc_id: r for r in secrets.secrets(docs(rows)).collect()}
    wrong = [(rows[k][1], [(s.start, s.end) for s in got[k].copies], want[k]) for k in want if sorted({(s.start, s.end) for s in got[k].copies}) != want[k]]
    assert wrong == [] and sum(map(len, want.values())) > 30
    assert {k: (r.n_live, r.n_example) for k, r in got.items()} == counts and {v for c in counts.values() for v in c} > {0, 1}


def test_copies_of_padded_and_glued_values(docs):
    """A live value is found with or without its padding, a full stop, a name or a path."""
    pad, own, path, short = "Zm9vYmFyMTIzNDU2Nzg5MA==", "liveKey9876543210", "ab1/Cd2+ef3/Gh4=Ij5", "kq7wz2======"
    lines = {
        1: f"here password={pad} and token: {own}. Then secret=+{path}/ and api_key={short} end",
        2: f"bare ({pad[:-2]}) here",
        3: f"bare ({pad}) at the end {own}.",
        4: f"export GH={own} now",
        5: f"see https://example.com/x1/hooks/{own}/tail9 there",
        6: f"mv x/{path}/y0 and z={short} but not x/kq7wz2/y0/0",
        7: f"{own}0 x{own} and {path}7",
        8: "-=/+.=" * 3 + " token=" + "=" * 14 + " a1" + "/" * 20000 + "b" + "." * 20000 + "c2",
    }
    expect = {2: [pad[:-2]], 3: [pad[:-2], own], 4: [own], 5: [own], 6: [path, "kq7wz2"], 7: [], 8: []}
    df = docs([(k, t, "en", f"s{k % 2}") for k, t in lines.items()])
    got = {r.doc_id: [lines[r.doc_id][s.start : s.end] for s in r.copies] for r in secrets.secrets(df).collect()}
    assert {k: got[k] for k in expect} == expect
    out = {r.doc_id: r.text for r in secrets.redact_documents(df).collect()}
    assert not any(v in out[k] for v in (pad[:-2], own, path) for k in range(1, 7))
    shown = "exampleKey1234567"
    rows = [(k, f"doc {k} token={shown}{end} ok", "en", f"s{k}") for k, end in enumerate(["", ".", "=="])]
    assert all((r.n_example, r.n_live) == (1, 0) for r in secrets.secrets(docs(rows)).collect())


def test_odd_rows(odd, docs):
    for run in (pii.personal_data, secrets.secrets):
        assert run(odd).count() == odd.count()
        assert run(odd.limit(0)).count() == 0
    again = secrets.redact_documents(odd)
    assert again.columns == odd.columns and again.exceptAll(odd).isEmpty() and odd.exceptAll(again).isEmpty()
    clashing = odd.withColumn("base", F.lit(1)).withColumn("row_id", F.lit(2)).withColumn("_t", F.lit(3))
    assert secrets.redact_documents(clashing).columns == clashing.columns
    assert pii.personal_data(clashing).count() == odd.count()
