import gzip
import hashlib
import io
import math
import random
import re
import struct
import sys
import unicodedata
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell.llm import chat, langid, media, pieces, urlfilter

# Pieces -----------------------------------------------------------------------------


def test_ids_offsets_and_round_trip(docs, odd, spark):
    texts = ["", " ", "Hello  world\n", "é😀 \x00 x", " lead and trail ", "日本語 text", "a" * 3000, "▁ literal"]
    p = pieces.pieces_of(pieces.default_model())
    rows = {r.doc_id: r for r in pieces.encode(docs(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = p.library.encode(t, add_bos=True, add_eos=True)
        data = t.encode()
        r = rows[k]
        assert r.ids == want and r.decoded == p.library.decode(want)
        assert r.begins[0] == r.ends[0] == 0 and r.ends[-1] == len(data)
        assert r.ends[:-1] == r.begins[1:]
        assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == data
    digest = {r.doc_id: r for r in pieces.digest(docs(list(enumerate(texts)))).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert all(digest[k].ids_sha256 == sha(np.array(rows[k].ids, "<u4").tobytes()) for k in rows)
    assert all(digest[k].decoded_sha256 == sha(rows[k].decoded.encode()) for k in rows)
    assert pieces.digest(odd).count() == odd.count() and pieces.digest(odd.limit(0)).isEmpty()


def test_longest_prefix_of_a_character_map():
    """A trie of "a" to "x" and "ab" to "" in the compiled form."""
    texts = b"x\0\0"

    units = [0] * 1024
    put = lambda at, offset, label, leaf: units.__setitem__(at, (offset << 10) | (leaf << 8) | label)
    # From the root at 0 with offset 1: "a" at 1 ^ 97; its children at offset 512.
    put(0, 1, 0, 0)
    a = 1 ^ ord("a")
    put(a, a ^ 512, ord("a"), 1)
    units[512] = 0x80000000 | 0
    b = 512 ^ ord("b")
    put(b, b ^ 700, ord("b"), 1)
    units[700] = 0x80000000 | 2
    blob = struct.pack("<I", 4096) + struct.pack("<1024I", *units) + texts
    m = pieces.CharacterMap(blob)
    assert m.longest(b"ab", 0) == (2, b"") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None
    p = pieces.pieces_of(pieces.default_model())
    own = object.__new__(pieces.Pieces)
    own.__dict__.update(p.__dict__)
    own.map = m
    out, origin = own.normalised("caab é")
    assert out.decode() == "▁cx▁é"
    assert origin.tolist() == [0, 0, 0, 0, 1, 4, 4, 4, 5, 5, 7]


def mapped_model():
    """The model with a public character map (compatibility forms, as the library has it)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    own = sentencepiece_model_pb2.ModelProto.FromString(norm.serialized_model_proto())
    with open(pieces.default_model(), "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    return proto


@pytest.mark.parametrize("squeeze, prefix", [(True, True), (False, True), (True, False), (False, False)])
def test_character_map_against_the_library(tmp_path, squeeze, prefix):
    """Normalised text, ids and every piece's place, with a model that maps characters."""
    proto = mapped_model()
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, prefix
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    p = pieces.Pieces(str(path))
    assert len(p.map.units) > 1000
    rng = random.Random(15)
    alphabet = ["a", "b", " ", "  ", "\t", "\n", "ﬁ", "①", "Ａ", "ガ", "ｶﾞ", "é", "e\u0301", "½", "㎏", "\u3000", "\u200b", "\x07", "😀", "日", "한", "ſ", "…", "▁", "\xa0", "\ufeff"]
    texts = ["", " ", "ﬁ ①Ａ ｶﾞ", *("".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(600))]
    for t in texts:
        out, origin = p.normalised(t)
        assert out.decode() == p.library.normalize(t), t
        assert len(origin) == len(out) + 1 and all(a <= b for a, b in zip(origin, origin[1:]))
        ids = np.array(p.library.encode(t, add_bos=True, add_eos=True), dtype=np.int64)
        begin, end = p.spans(t, ids)
        chars = len(t.encode())
        assert begin[0] == end[0] and begin[-1] == end[-1] and (begin <= end).all() and end.max(initial=0) <= chars
        # The library gives places too; only how the bytes of one character share theirs differs.
        theirs = [(x.begin, x.end) for x in p.library.encode(t, return_type="proto").pieces if not p.library.is_byte(x.id)]
        ours = [(int(a), int(b)) for i, a, b in zip(ids[1:-1], begin[1:-1], end[1:-1], strict=True) if not p.library.is_byte(int(i))]
        assert ours == theirs, t


def test_pieces_odd_rows(odd):
    clashing = odd.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    got = pieces.encode(clashing)
    assert got.columns == ["doc_id", "ids", "begins", "ends", "decoded"] and got.count() == odd.count()
    assert len({tuple(r.ids) for r in got.where("doc_id = 4").collect()}) == 1
    assert [r.ids for r in got.where("doc_id IN (1, 2)").collect()] == [[1, 2]] * 2
    assert pieces.encode(odd.limit(0)).isEmpty()


# Media -----------------------------------------------------------------------------


def png(data=b"\0\0"):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_stored_form_is_a_wav_that_others_read():
    with wave.open(io.BytesIO(media.stored(b"abc" * 64))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(1000)) == (1, 1, b"abc" * 64)


def test_sniffing_corrects_and_carves(spark):
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "x")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
    cases = {
        "image/png": png(), "application/gzip": gzip.compress(b"x" * 99), "application/zip": z.getvalue(), "image/bmp": bmp,
        "image/gif": gif, "audio/wav": media.stored(b"q" * 64), media.UNKNOWN: b"BM and %PDF- or RIFF but not really",
    }
    rows = [(k, "image/png", bytearray(v)) for k, v in cases.items()]
    rows += [("inside", "audio/wav", bytearray(media.stored(b"pad" + png() + b"!" * 9))), ("cut", "image/png", bytearray(png()[:-3])), ("null", None, None), ("empty", "x", bytearray())]
    df = spark.createDataFrame(rows, "id string, declared string, content binary")
    got = {r.id: r for r in media.inspect(df).collect()}
    assert {k: got[k].detected for k in cases} == {k: k for k in cases}
    assert got["image/png"].corrected is False and got["image/gif"].corrected is True
    assert [(e.type, bytes(e.content)) for e in got["inside"].embedded] == [("image/png", png())]
    assert got["cut"].detected == media.UNKNOWN and got["null"].detected is None and got["empty"].detected == media.UNKNOWN


def test_ends_of_nested_and_updated_files():
    """Archives with stored archives inside, and PDFs of several parts, are read whole."""
    import zipfile

    def packed(name, content):
        z = io.BytesIO()
        with zipfile.ZipFile(z, "w") as f:
            f.writestr(name, content)
            f.writestr("last", "x")
        return z.getvalue()

    inner = packed("a", "x" * 20)
    outer = packed("in.zip", inner)
    at = outer.index(inner)
    kind = "application/zip"
    assert media.sniff(outer) == [(kind, 0, len(outer)), (kind, at, at + len(inner))]
    assert media.sniff(b"pad" + outer + inner)[0] == (kind, 3, 3 + len(outer))

    def pdf(body, update=b""):
        out = b"%PDF-1.7\n" + body + update
        return out + b"xref\n0 0\ntrailer\nstartxref\n%d\n%%%%EOF" % len(out)

    kind, plain = "application/pdf", pdf(b"1 0 obj endobj\n")
    linear = pdf(b"1 0 obj endobj\nxref\nstartxref\n0\n%%EOF\n", b"\n2 0 obj endobj\n")
    assert media.sniff(linear) == [(kind, 0, len(linear))]
    two = linear + b"\n" + plain
    assert media.sniff(two) == [(kind, 0, len(linear)), (kind, len(linear) + 1, len(two))]
    holder = pdf(b"1 0 obj stream " + plain + b" endobj\n")
    assert media.sniff(holder) == [(kind, 0, len(holder)), (kind, holder.index(plain), holder.index(plain) + len(plain))]
    loose = b"%PDF-1.4 startxref 5 %%EOF more startxref 6 %%EOF"
    assert media.sniff(loose + b"tail") == [(kind, 0, len(loose))]


def plain_sniff(data):
    """Each format tried at each place of its magic bytes, by a plain search."""
    out = []
    for kind, magic, valid in media.FORMATS:
        at = data.find(magic)
        while at >= 0:
            media.marks.cache_clear()
            if (end := valid(data, at)) is not None:
                out.append((kind, at, end))
            at = data.find(magic, at + 1)
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def test_carving_mixed_content_against_what_was_put_in(spark):
    """Files of many formats between noise: carved where they were put, as they were."""
    import zipfile

    rng = random.Random(13)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "x" * 50)
    pdf = b"%PDF-1.4\n1 0 obj endobj\nxref\n0 0\ntrailer\nstartxref\n25\n%%EOF"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02scan\xff\xd9"
    kinds = {"image/png": png(), "application/zip": z.getvalue(), "application/pdf": pdf, "image/jpeg": jpeg, "audio/wav": media.stored(b"s" * 64), "application/gzip": gzip.compress(b"y" * 50)}
    rows, want = [], {}
    for k in range(60):
        data, put = b"", []
        for _ in range(rng.randint(0, 5)):
            data += bytes(rng.choices(b"abc \n\x00RIFPKBM%", k=rng.randint(0, 40)))
            kind = rng.choice(list(kinds))
            put.append((kind, len(data), len(data) + len(kinds[kind])))
            data += kinds[kind]
        rows.append((k, rng.choice(list(kinds)), bytearray(data)))
        want[k] = put
        assert media.sniff(data) == plain_sniff(data)
    for r in media.inspect(spark.createDataFrame(rows, "id int, declared string, content binary")).collect():
        data, put = bytes(rows[r.id][2]), want[r.id]
        got = [(e.type, e.start, e.end) for e in r.embedded]
        assert [p for p in put if p[1]] == got and all(bytes(e.content) == data[e.start : e.end] for e in r.embedded)
        assert r.detected == next((p[0] for p in put if p[1] == 0), media.UNKNOWN) and r.corrected == (r.detected != rows[r.id][1])


def test_many_headers_take_one_search():
    import time

    for piece in (b"%PDF-1.4 ", b"PK\x03\x04" + b"\0" * 30, b"\xff\xd8\xff\xda\x00\x02", b"startxref 1 %%EOF ", b"GIF89a"):
        began = time.monotonic()
        media.sniff(piece * 60000)
        assert time.monotonic() - began < 20, piece


def test_feature_against_loops(docs, odd):
    """Every field of the feature, from the text alone."""
    rng = random.Random(14)
    texts = ["", "a", "é" * 32, "RIFF....WAVE", "%PDF-1.4 startxref 5 %%EOF", *("".join(rng.choices("abé😀 \n%PDF-1", k=rng.randint(0, 200))) for _ in range(40))]
    for r in media.digest(docs(list(enumerate(texts)) + [(0, "")])).collect():
        data = texts[r.doc_id].encode()
        payload = list(data) + [0] * (-len(data) % 64 or 64 * (not data))
        fields = dict(f.split("=", 1) for f in r.feature.split(";"))
        head = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
        head += b"".join(x.to_bytes(n, "little") for x, n in ((1, 2), (1, 2), (8000, 4), (8000, 4), (1, 2), (8, 2)))
        whole = head + b"data" + len(payload).to_bytes(4, "little") + bytes(payload)
        inside = ",".join(f"{t}@{a}-{e}" for t, a, e in plain_sniff(whole) if a)
        assert fields == {
            "type": "audio/wav", "samples": str(len(payload)), "sum": str(sum(payload)), "squares": str(sum(x * x for x in payload)),
            "values": str(len(set(payload))), "inside": inside,
        }
        assert (r.media_bytes, r.media_sha256) == (len(whole), hashlib.sha256(whole).hexdigest())
    clashing = odd.withColumn("feature", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    assert media.digest(clashing).where("feature = '1'").isEmpty()


def test_media_digest(docs, odd):
    texts = ["", "a", "é" * 32, "x" * 64, "y" * 65]
    for r in media.digest(docs(list(enumerate(texts)))).collect():
        data = texts[r.doc_id].encode()
        payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.feature.startswith("type=audio/wav")
    assert media.digest(odd).count() == odd.count() and media.digest(odd.limit(0)).isEmpty()


# Languages ---------------------------------------------------------------------------


def plain_words(text):
    """Letter by letter: a word begins with a letter and goes on with letters and marks."""
    out, now = [], ""
    for c in text.lower():
        if c.isalpha() or (now and unicodedata.category(c).startswith("M")):
            now += c
        else:
            out, now = out + [now] * bool(now), ""
    return out + [now] * bool(now)


def test_words_over_every_category():
    by = {}
    for k in range(sys.maxunicode + 1):
        by.setdefault(unicodedata.category(chr(k)), []).append(chr(k))
    rng = random.Random(8)
    some = [c for cs in by.values() for c in rng.sample(cs, min(40, len(cs)))]
    for c in some:
        for text in (c, f"a{c}b", f"{c}a", f"1{c}"):
            assert langid.words_of(text) == plain_words(text), (hex(ord(c)), text)
    for _ in range(300):
        text = "".join(rng.choices(some, k=30))
        assert langid.words_of(text) == plain_words(text)
    assert [langid.words_of(x) for x in ("²", "½ ¾", "Ⅷ", "①②", "हिन्दी", "12")] == [[], [], [], [], ["हिन्दी"], []]


def plain_predictor(rows, longest=4, floor=0.5):
    """Dictionaries and loops over (lang, text): what the model must say."""
    words = plain_words
    counts, totals = {}, {}
    for lang, text in rows:
        for w in words(text):
            m = f"<{w}>"
            for term in [(0, w)] + [(n, m[k : k + n]) for n in range(1, longest + 1) for k in range(len(m) - n + 1)]:
                counts.setdefault(term, {}).setdefault(lang, 0)
                counts[term][lang] += 1
                totals[lang, term[0]] = totals.get((lang, term[0]), 0) + 1
    langs = sorted({g for g, _ in rows})

    def logs(term):
        return [math.log((counts[term].get(g, 0) + floor) / (totals.get((g, term[0]), 0) + 1)) for g in langs]

    def predict(text):
        found = words(text or "")
        if not found or not langs:
            return "und", 0.0
        total = [0.0] * len(langs)
        for w in found:
            m, rows = f"<{w}>", [logs((0, w))] if (0, w) in counts else []
            if not rows:
                for k in range(len(m)):
                    best = next((n for n in range(longest, 0, -1) if k + n <= len(m) and (n, m[k : k + n]) in counts), None)
                    rows += [logs((best, m[k : k + best]))] if best else []
            for j in range(len(langs)):
                total[j] += sum(r[j] for r in rows) / max(len(rows), 1)
        top = max(total)
        return langs[total.index(top)], 1 / sum(math.exp(max(t - top, -700)) for t in total)

    return predict


def test_predictions_against_dictionaries(docs, monkeypatch):
    """Every word and n-gram of the sample counts; also when little is remembered."""
    rng = random.Random(5)
    rows = []
    for k in range(150):
        g = rng.choice(["aa", "bb", "cc", None])
        rows.append((k, " ".join("".join(rng.choices("abcdeéß"[: 4 + 3 * (g == "cc")], k=rng.randint(1, 6))) for _ in range(rng.randint(0, 12))), g, "s"))
    rows += [(1000 + k, "zupqil vexjom", "small", "s") for k in range(3)] + [(2000, None, "aa"), (2001, "aaaa Aab! 12 _b\u00adc"), (2002, "日本語 ǅ")]
    plain = plain_predictor([(g, t) for _, t, g, *_ in [(*r, "en") for r in rows] if g is not None and t is not None])
    for cached in (1 << 17, 7):
        monkeypatch.setattr(langid, "CACHED", cached)
        model = langid.fit(docs(rows))
        for _, t, *_ in rows:
            (lang, score), (want, p) = model.predict(t), plain(t)
            assert abs(score - p) < 1e-5 and (lang == want or abs(p - 0.5) < 1e-5), t
    assert model.predict("zupqil")[0] == "small"


def test_sample_is_drawn_before_it_is_joined(docs):
    rows = [(k, f"text {k}", "en" if k % 10 else "fr", "s") for k in range(4000)]
    for many in (100, 0):
        n = dict(langid.sample(docs(rows).select("doc_id", "lang", "text"), 600, many).groupBy("lang").count().collect())
        assert n["fr"] == 400 and 450 < n["en"] < 750
    plan = langid.sample(docs(rows).select("doc_id", "lang", "text"), 600)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_language_odd_rows(odd):
    clashing = odd.withColumn("score", F.lit(1)).withColumn("share", F.lit("x")).withColumn("_lang", F.lit("y")).withColumn("n", F.lit(2))
    model = langid.fit(clashing)
    got = langid.predict(clashing, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == odd.count()
    again = [(r.lang_pred, r.score) for r in got.where("doc_id = 4").collect()]
    assert len(again) == 2 and again[0] == again[1]
    assert {r.lang_pred for r in got.where("doc_id IN (1, 2, 5)").collect()} == {"und"}
    assert got.where("doc_id = 3").first().score > 0 and langid.predict(odd.limit(0), model).isEmpty()


def test_held_out_accuracy(docs):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "mo", "ti"], "bb": ["schu", "gen", "ber"], "cc": ["é", "eau", "que"]}
    rows = [(k, " ".join("".join(rng.choices(syllables[g], k=3)) for _ in range(20)), g, "s") for k in range(600) for g in [rng.choice(list(syllables))]]
    df = docs(rows + [(9001, None), (9002, "123 --"), (9003, "", None, None)])
    train = df.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)))
    model = langid.fit(train.where("doc_id < 9000"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert np.mean([got[k].lang_pred == g for k, _, g, _ in rows]) > 0.99
    assert [(got[k].lang_pred, got[k].score) for k in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())


def model_of(langs, totals, terms):
    """From counts by (kind, term) and language."""
    flat = [(langid.hash_of(*t), t[0], langs.index(g), n) for t, by in terms.items() for g, n in by.items()]
    h, k, w, n = zip(*flat, strict=True)
    return langid.Model(langs, np.array(totals, dtype=float), np.array(h, np.uint64), np.array(k), np.array(w), np.array(n))


def test_word_first_then_longest_ngram():
    terms = {(0, "cat"): {"a": 5}, (1, "c"): {"a": 1}, (3, "<ca"): {"b": 9}, (2, "at"): {"b": 9}}
    m = model_of(["a", "b"], [[10, 10]] * 5, terms)
    rows = dict(zip(terms, m.place(list(terms)).tolist(), strict=True))
    assert m.longest(["<cab", "cab>", "ab>", "b>", ">"]).tolist() == [rows[3, "<ca"], rows[1, "c"], -1, -1, -1]
    assert m.predict("cat")[0] == "a" and m.predict("catty")[0] == "b"
    assert m.predict("xyz") == ("a", 0.5)


def test_nothing_learned(docs):
    df = docs([(1, "some words", None, "s")])
    assert [(r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df)).collect()] == [("und", 0.0)]
    assert langid.fit(df.limit(0)).langs == []


# Urls ----------------------------------------------------------------------------------


def fits(line, url):
    """A rule of a filter list, held against a url by walking both."""
    case = "$match-case" in line
    body = re.sub(r"\$[a-z,-]+$", "", line.removeprefix("@@"))
    head, _, rest = url.partition("://")
    host = re.match("[^/?#]*", rest)[0]
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    text = head + "://" + low(host) + rest[len(host) :]
    if len(body) > 2 and body[0] == body[-1] == "/":
        return re.search(body[1:-1], text, re.S | (0 if case else re.I | re.A)) is not None
    if not case:
        text, body = low(text), low(body)
    first = len(head) + 3
    if body.startswith("||"):
        body, starts = body[2:], [first] + [first + k + 1 for k, c in enumerate(host) if c == "."]
    elif body.startswith("|"):
        body, starts = body[1:], [0]
    else:
        starts = range(len(text) + 1)
    ends = body.endswith("|")
    body = body.removesuffix("|")
    at = set(starts)
    for c in body:
        if c == "*":
            at = set(range(min(at), len(text) + 1)) if at else at
        elif c == "^":
            at = {k + 1 for k in at if k < len(text) and not re.match("[A-Za-z0-9_.%-]", text[k])} | {k for k in at if k == len(text)}
        else:
            at = {k + 1 for k in at if k < len(text) and text[k] == c}
    return len(text) in at if ends else bool(at)


def plain_verdict(url, method=urlfilter.METHOD, fit=fits):
    host, path = urlfilter.split_url(url)
    good = [(a, h + p) for a, h, p in urlfilter.PREFIXES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(good, key=lambda x: len(x[1]), default=None)
    own = [r for r in method if url and "://" in url and fit(r.text, url)]
    kinds = [[r for r in own if r.action == "block" and r.important], [r for r in own if r.action == "allow"], own]
    best = next((sorted(k, key=lambda r: (-len(r.name), r.name))[0] for k in kinds if k), None)
    return host, path, rule and rule[1], rule[0] if rule else best.action if best else "allow", best and best.name


def random_urls(rng, n):
    parts = ["http", "https", "://", "://", "x", ".", "com", "net", "org", "example", "/", "/en/", "/de/", "/es/", "7", "8", "?", "#", ":", "cheap-pills", "casino", "-", "help", "Ads", "/ads/", "popup_id=", "A", "EN", "é", "@", "ſ", "K"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(n)]


def test_rules_against_every_rule_on_every_url(spark):
    """Generated lists of thousands of rules: the index must find what running all does."""
    rng = random.Random(11)
    pieces = ["a", "b", "ad", "x1", "com", "example", "net", "/", ".", "-", "*", "^", "?", "=", "/en/", "Q", "_"]
    lines = ["! comment", "[Header]", "", "example.com##.ad"]
    for _ in range(3000):
        body = "".join(rng.choices(pieces, k=rng.randint(2, 6)))
        if not body.strip("*|^") or (body[0] == body[-1] == "/"):
            continue
        line = rng.choice(["", "", "||", "||", "|"]) + body + rng.choice(["", "", "^", "|"])
        lines.append(rng.choice(["", "", "", "@@"]) + line + rng.choice(["", "", "$match-case", "$important"]))
    lines += ["/ad[0-9]+x/", "@@/B$/$match-case"]
    method = urlfilter.parse_list("\n".join(lines))
    assert len(method) > 1500
    urls = ["".join(rng.choices([*pieces, "://", "http", "7"], k=rng.randint(3, 16))) for _ in range(150)] + random_urls(rng, 50)
    urls = [u if "://" in u else "http://" + u for u in urls]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in urlfilter.judge(df, method=method).collect()}
    wrong = [(u, got[k], want) for k, u in enumerate(urls) if tuple(got[k][1:]) != (want := plain_verdict(u, method))]
    assert wrong == []


def test_default_rules_against_loop(spark):
    rng = random.Random(12)
    urls = random_urls(rng, 400)
    urls += [None, "", "com/en/", "http://com/en/", "http://xcom/en/", "HTTP://A.Example.COM/en/78?x", "http://a.example.net/de/8", "http://a.net/de/8", "a:b://c.org/es/", "http://www.cheap-pills.example.com/fr/1", "http://xcheap-pills.com/", "http://casino-help.net/x", "http://h.de/" + "a/" * 30000 + "ads/x"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(9, urls[9])], "page_id bigint, url string").withColumn("host", F.lit("mine")).withColumn("token", F.lit(1))
    rows = urlfilter.judge(df).collect()
    got = {r.page_id: r for r in rows}
    # Only rules that share a letter run with the url can fit; all the others are left out here.
    wrong = [(u, got[k], want) for k, u in enumerate(urls) if tuple(got[k][1:]) != (want := plain_verdict(u, fit=lambda r, u: urlfilter.compiled(by[r]).search(urlfilter.lowered(u)) is not None))]
    assert wrong == [] and len(rows) == len(urls) + 1
    assert urlfilter.judge(df.limit(0)).isEmpty()


by = {r.text: r for r in urlfilter.METHOD}


def test_tokens_are_whole_in_every_match():
    tokens = lambda line: urlfilter.parse_rule(line).tokens
    assert tokens("||cheap-pills.") == ("cheap", "pills") and tokens("||ads") == () and tokens("||ads^") == ("ads",)
    assert tokens("/ads/*") == ("ads",) and tokens("ads/x*y/z|") == ("z",) and tokens("|http://a*b.c") == ("http", "b")[:1]
    assert tokens("/ad[0-9]/") == () and tokens("^Id=") == ("id",)
    with pytest.raises(ValueError):
        urlfilter.parse_rule("||a.com^$third-party")
    with pytest.raises(ValueError):
        urlfilter.parse_rule("*")


def test_rules_are_filed_under_their_rarest_token():
    index = urlfilter.Index(urlfilter.FIXED, {"com": 100, "en": 50, "net": 3, "de": 9, "example": 70, "org": 1, "es": 1})
    filed = {index.rules[k].name: t for t, rules in index.by_token.items() for k in rules}
    assert filed == {"com/en/": "en", "example.com/en/7": "en", "net/de/": "net", "example.net/de/8": "net", "org/es/": "es"}


def test_fixed_rules_give_the_verdicts_of_the_contract(spark):
    """Written out here, not taken from the code."""
    want = {
        "http://a.com/en/": "block", "http://example.com/en/": "block", "http://w.example.com/en/7": "allow",
        "http://casino.net/de/": "allow", "http://example.net/de/7": "allow", "http://w.example.net/de/8": "block", "http://b.org/es/": "block",
    }
    df = spark.createDataFrame(list(enumerate(want)), "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df).collect()} == dict(enumerate(want.values()))


# Chat -----------------------------------------------------------------------------------


def test_snapshots_collapse(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(conv, k, r, t) for conv, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for k, (r, t) in enumerate(talk[:n])]
    rows += [(5, 0, "user", "a"), (5, 1, "assistant", "other <|im_end|>"), (6, None, None, None), (2, 0, "user", "a"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("place", F.lit(1))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {2, 5, 6, None}
    assert (got[2].n_turns, got[2].n_equal) == (4, 2)
    assert got[2].rendered == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in talk)
    assert "< |im_end|>" in got[5].rendered and got[6].rendered == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.format_conversations(df.limit(0)).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_against_loop(spark, seed):
    rng = random.Random(seed)
    convs = {}
    for c in range(120):
        base = convs[rng.randrange(c)] if c and rng.random() < 0.6 else []
        convs[c] = (base[: rng.randint(0, len(base))] + [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randint(0, 2))]) or [("u", "x")]
    rows = [(c, k, *t) for c, ts in convs.items() for k, t in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = {}
    for c, ts in convs.items():
        whole.setdefault(tuple(ts), []).append(c)
    inside = {k[:n] for k in whole for n in range(1, len(k))}
    want = {min(cs): (len(k), len(cs)) for k, cs in whole.items() if k not in inside}
    assert {r.conv_id: (r.n_turns, r.n_equal) for r in chat.format_conversations(df).collect()} == want


def test_turns_without_a_conversation(spark):
    """Each is a conversation of one turn: rendered once, and gone where it begins another."""
    rows = [(None, k, "user", f"t{k % 3}") for k in range(30)] + [(7, 0, "user", "t0"), (7, 1, "bot", "x"), (8, 0, "user", "t1"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("h1", F.lit(1)).withColumn("sha", F.lit("s"))
    got = sorted(((r.conv_id or 0), r.n_turns, r.n_equal, r.rendered) for r in chat.format_conversations(df).collect())
    one = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == [(0, 1, 1, one("unknown", "")), (0, 1, 10, one("user", "t2")), (7, 2, 1, one("user", "t0") + one("bot", "x")), (8, 1, 11, one("user", "t1"))]


def test_long_conversations_and_texts(spark):
    rows = [(1, k, "user" if k % 2 else "bot", f"turn {k}") for k in range(3000)] + [(2, k, "user" if k % 2 else "bot", f"turn {k}") for k in range(2999)]
    rows += [(3, 0, "user", "y" * 500000)]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {1, 3} and got[1].n_turns == 3000 and got[1].rendered.count("<|im_end|>") == 3000 and len(got[3].rendered) > 500000


# Durable tables ---------------------------------------------------------------------------


def test_durable_tables_are_removed(spark, docs):
    import os

    from citewell.llm import common

    kept = common.durable(docs([(1, "a")]), "kept")
    (folder,) = {f.rpartition("/")[0].removeprefix("file://") for f in kept.inputFiles()}
    assert os.path.isdir(folder) and kept.count() == 1
    common.clean(spark)
    assert not os.path.exists(folder)
