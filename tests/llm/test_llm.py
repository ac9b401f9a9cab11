"""The training-data operators against brute force, on edge cases and on small real tables."""

import hashlib
import html as entities
import math
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import align, lzprint, mixing, neardup, packing, pagediff, preference, queries, repeats, simplex, toxicity, urltree, vectors, warc
from llm.common import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, n long, bucket string, key string, size long"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "s", 1, "b", "k", 2) for i, t in enumerate(texts)], DOC)


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS)
TEXTS = [LONG, LONG, " ".join(WORDS[:390] + ["other"] * 10), None, "", "one two", "one  TWO", " \t ", "x" * 90_000, " ".join(WORDS[200:] + [f"v{i}" for i in range(300)])]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["component"] for r in components(chain).collect()} == {0}


def brute_near(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, *TEXTS)).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute_near(TEXTS)
    assert neardup.near_duplicates(docs(spark, "a").limit(0)).count() == 0
    null = spark.createDataFrame([(None, LONG), (1, LONG), (1, LONG)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in neardup.near_duplicates(null).collect()))) == sorted(map(str, [(None, 396, None, True), (1, 396, 1, True), (1, 396, 1, True)]))


def test_near_duplicates_in_large_buckets(spark):
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(120):
        w = list(base)
        for p in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            w[p] = f"e{k}x{p}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_near(texts)


def brute_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        m = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                m[i : i + length] = 1
        out.append((len(d), int(m.sum()), int((np.diff(np.concatenate([[0], m])) == 1).sum()), hashlib.sha256(bytes(b for b, x in zip(d, m) if not x)).hexdigest()))
    return out


def test_repeats(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdefghé ilmno"), n))
    passage = text(700)
    texts = [text(300) + passage + text(500), text(100) + passage[:450] + text(99), passage[250:] + text(450), text(600), None, "", "short", "z" * 2000, "ab" * 900,
             text(50) + passage[100:499] + text(80), *([text(420)] * 3), ("line of text, " * 60) + text(300)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs(spark, *texts).select("doc_id", "text")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    assert repeats.remove_repeats(docs(spark, "a").limit(0)).count() == 0
    kept = repeats.remove_repeats(docs(spark, *texts), texts=True)
    assert kept.where("doc_id = 4").first()["kept_text"] is None and "bucket" in kept.columns


def test_repeats_of_another_length(spark):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdefgh ilmno"), n))
    passage = text(230)
    texts = [text(90) + passage + text(150), passage[15:] + text(80), text(60) + passage[:199] + text(60), "ab" * 150, "z" * 199, "z" * 200, *([text(210)] * 2)]
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    got = {r["doc_id"]: r["kept_text"] for r in repeats.remove_repeats(docs(spark, *texts).select("doc_id", "text"), texts=True, length=200).collect()}
    for k, d in enumerate(data):
        gone = {j for i in range(len(d) - 199) if seen[d[i : i + 200]] > 1 for j in range(i, i + 200)}
        assert got[k] == "".join(c for j, c in enumerate(texts[k]) if j not in gone)
    assert len(got[0]) == 470 - 215 and got[7] == ""


def test_repeats_in_hot_groups_and_periodic_texts(spark, monkeypatch):
    """Starts of groups over HOT are dealt by their hash; blocks and pieces end inside texts."""
    rng = np.random.default_rng(12)
    text = lambda n: "".join(rng.choice(list("abcdefgh ilmno"), n))
    licence = text(600)
    texts = [*(text(150) + licence[: 380 + 7 * k] + text(90) for k in range(30)), "ab" * 3000, "z" * 7000, text(60) + "z" * 900, ("line of text, " * 400) + text(300), text(2500), None, text(399)]
    monkeypatch.setattr(repeats, "HOT", 300)
    monkeypatch.setattr(repeats, "BLOCK", 1024)
    d = docs(spark, *texts).select("doc_id", "text", F.lit(1).alias("n_repeated"), F.lit(2).alias("key"), F.lit(3).alias("cover"))
    got = {r["doc_id"]: r for r in repeats.remove_repeats(d, also=200).collect()}
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == brute_repeats(texts)
    assert [got[i]["n_repeated"] for i in range(len(texts))] == [n for _, n, _, _ in brute_repeats(texts, 200)]
    assert got[0]["key"] == 2 and got[0]["cover"] == 3


def test_repeats_of_a_long_periodic_text_stay_small():
    import tracemalloc

    data = np.full(4_000_000, 122, np.uint8)
    tracemalloc.start()
    name, times, lo, hi = repeats.anchors(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000 and len(name) == 1 and (lo[0], hi[0]) == (0, 4_000_000 - 400)


def test_pipeline_cuts_repeats_of_51_words(spark):
    import corpus_pipeline

    passage = " ".join(f"s{i % 7}{i:03}" for i in range(51))
    assert 200 <= len(passage) < 400
    rows = [(i, " ".join(f"{c}{j:04}{c}" for j in range(70)) + f" {passage} " + " ".join(f"{c}{j:04}{c}" for j in range(70, 140))) for i, c in enumerate("pqr")]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert out == {i: t.replace(f" {passage} ", "") for i, t in rows}


def test_pipeline_keeps_one_of_repeated_rows(spark):
    """Rows that repeat a doc_id, and copies with a null doc_id, leave one row that the next stage keeps whole."""
    import corpus_pipeline

    texts = {c: " ".join(f"{c}{i:03}" for i in range(120)) for c in "pqrstu"}
    p, q, r, s, t, u = texts.values()
    rows = [(1, p)] * 40 + [(2, q), (None, q), (None, q)] + [(None, r)] * 2 + [(5, s), (5, t), (4, t), (6, u), (7, u + " more")] + [(8, ""), (9, ""), (8, ""), (None, None), (None, None), (10, " \n" * 300), (11, " \n" * 300)]
    d = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, node int").repartition(5)
    one = corpus_pipeline.drop_near_duplicates(spark, d, "")
    want = [(1, p), (2, q), (None, r), (5, s), (4, t), (6, u), (8, ""), (9, ""), (None, None), (10, " \n" * 300), (11, " \n" * 300)]
    assert one.columns == d.columns and sorted(map(str, ((x["doc_id"], x["text"]) for x in one.collect()))) == sorted(map(str, want))
    two = corpus_pipeline.drop_repeats(spark, one, "")
    assert sorted(map(str, ((x["doc_id"], x["text"]) for x in two.collect()))) == sorted(map(str, want[:-2]))
    assert corpus_pipeline.drop_near_duplicates(spark, d.limit(0), "").count() == 0


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    extra = [None, "", "It's HERE, isn't it? <|endoftext|> a b.\x1c c d İx, 3.14. é, A,. .,", "word " * 6000, "no" * 9000]
    texts |= {10_000 + i: t for i, t in enumerate(extra)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    rows = packing.pack(df, path).collect()
    tok = Tokenizer.from_file(path)
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == d)
        at = 0
        for start, length, crc, n in own:
            assert start == at and n == len(ids) and zlib.crc32(ids[at : at + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in by.values())
    assert pad <= 0.02 * sum(by.values()) + 2 * 2048


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(20):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 60, 25))])
        pens = np.concatenate([[0], rng.integers(0, 20, 25)])
        best = [0] + [10**9] * 25
        for j in range(1, 26):
            for i in range(j):
                n = places[j] - places[i]
                if n <= 100:
                    best[j] = min(best[j], best[i] + (100 - n) + pens[j] + packing.OPEN)
        got = packing.cuts(places, pens, 100)
        cost = sum(100 - (places[b] - places[a]) + pens[b] + packing.OPEN for a, b in zip(got, got[1:]))
        assert cost == best[-1]


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), s, 1) for i, s in enumerate(["a"] * 60 + ["b"] * 10 + [None] * 20)] + [(90, None, "c", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long").drop("taken")
    m = mixing.mix(d).collect()
    total = sum(r["size"] for r in m)
    by = {r["source"]: (r["source_size"], r["target"]) for r in m}
    assert abs(sum(t for _, t in by.values()) - min(1.5 * total, 2 * total)) < 1e-6
    for s, (size, target) in by.items():
        taken = sum(r["taken"] for r in m if r["source"] == s)
        assert target <= 2 * size and taken == int(target + 0.5)
    assert all(r["taken"] <= 2 * r["size"] for r in m)
    assert sorted(map(str, m)) == sorted(map(str, mixing.mix(d.repartition(5)).collect()))
    out = mixing.mixed(d)
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(r["taken"] for r in m) and out.columns == d.columns
    assert mixing.mix(d.limit(0)).count() == 0
    assert mixing.first_words("a  b c", 2) == "a  b"


def test_toxicity(spark):
    assert toxicity.fold("You 1D1OT, Ѕсum s​cum café 2024") == ["you", "idiot", "scum", "scum", "cafe", "2024"]
    lex = toxicity.Lexicon({"scum": 5.0}, {"idi": 4.0}, (("pond", "scum"),), (-3.0, 1.0, 1.0))
    a = lex.automaton()
    assert toxicity.features(["pond", "scum"], a) == (0.0, 0.0)
    assert toxicity.features(["you", "scum"], a)[0] > 1 and toxicity.features(["idiots"], a)[0] > 1
    d = docs(spark, "you scum", None, "", "pond scum", "fine words")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(d, lex).collect()}
    assert s[0] > 0.5 and s[1] == s[2] == s[3] == s[4] < 0.1
    none = toxicity.learn(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(d, none).where("score >= 0.3").isEmpty()


def test_toxicity_on_held_out_rows(spark):
    from llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.1"
    r = op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x["toxic"], x["predicted"]): x["count"] for x in r}
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.03 * (n.get((0, 1), 0) + n.get((0, 0), 0))


def test_warc(spark):
    body = "<p>" + "é" * 100 + "</p>"
    rows = [(1, "http://a/", body), (2, "http://b/ c", body), (3, None, None), (4, "x", ""), (5, "y", "small"), (6, "z", "small"), (None, "n", body), (7, "big", "WARC/1.1\r\n\r\n" * 9000), (1, "http://a/", body)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("first", F.lit("x"))  # clashing names
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["whole"]) for r in warc.round_trip(d).collect()), key=str)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = p == 2
        want.append((p or 0, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else None, True))
    assert got == sorted(want, key=str)
    assert warc.round_trip(d.limit(0)).count() == 0
    assert warc.dechunked(warc.chunked(b"x" * 10_000)) == b"x" * 10_000
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n0\r\n\r\nmore"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_warc_of_a_very_long_url_and_of_many_members():
    url = "http://a.example/" + "x" * (17 << 20)
    recs = warc.page_records(1, 0, url, b"<p>hi", None, 10_000)
    ms = [m for r in recs for m in warc.members(r)]
    assert len(ms) > len(recs) and all(m[-1] == 0 for m in ms)
    (fields, _), = warc.records_of(b"".join(ms))
    assert fields["warc-target-uri"] == url
    many = [m for i in range(6_000) for r in warc.page_records(i, i, "http://a", bytes([i % 256]) * 300, None, 1000) for m in warc.members(r)]
    began = time.time()
    assert sum(1 for _ in warc.records_of(b"".join(many))) == 6_000 and time.time() - began < 5
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records_of(b"".join(many)[:-3]))


def test_warc_missing_segment(spark):
    parts = b"".join(warc.page_records(1, 0, "u", b"q" * 50_000, None, 16_384))
    recs = [(f.get("warc-type"), f["warc-record-id"], f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, 1, None, f.get("warc-payload-digest"), 50_000, "u", b)
            for f, b in warc.records_of(parts)]
    df = spark.createDataFrame(recs, warc.RECORD)
    assert warc.payloads(warc.reassemble(df)).first()["whole"]
    assert not warc.payloads(warc.reassemble(df.where("number <> 2"))).first()["whole"]


def test_warc_revisits_are_resolved_from_what_was_read(spark):
    body = b"<p>" + b"e" * 200
    recs = [*warc.page_records(1, 0, "u", body, None, 16_384), *warc.page_records(2, 1, "u", body, 1, 16_384, "u"), *warc.page_records(3, 2, "u", body, 9, 16_384)]
    assert all(m[-1] == 0 for r in recs for m in warc.members(r))
    back = list(warc.records_of(b"".join(m for r in recs for m in warc.members(r))))
    assert [f["warc-type"] for f, _ in back] == ["response", "revisit", "revisit"] and back[1][0]["warc-refers-to-target-uri"] == "u"
    rows = [(f["warc-type"], f["warc-record-id"], f["warc-record-id"], None, None, int(f["x-page-id"]), int(f["x-refers-to-page"]) if "x-refers-to-page" in f else None,
             f["warc-payload-digest"], 7, "u", b) for f, b in back]
    got = {r["page_id"]: r for r in warc.payloads(spark.createDataFrame(rows, warc.RECORD).withColumn("whole", F.lit(True))).collect()}
    assert got[1]["whole"] and got[2]["whole"] and got[2]["payload_bytes"] == len(body) and got[2]["payload_digest"] == hashlib.sha256(body).hexdigest()
    assert not got[3]["whole"] and got[3]["payload_bytes"] is None and got[3]["payload_digest"] is None


def test_fingerprints(spark):
    d = docs(spark, *TEXTS)
    got = {r["doc_id"]: r for r in lzprint.fingerprints(d).collect()}
    for i, t in enumerate(TEXTS):
        t, nxt = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        f, g, h = map(lzprint.fingerprint, (t, e, nxt))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f.tobytes().hex(), g.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (lzprint.likeness(f, g), lzprint.likeness(f, h))
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0
    assert lzprint.fingerprints(d.limit(0)).count() == 0
    assert lzprint.fingerprints(d.limit(1)).count() == 1


def test_fingerprints_do_not_depend_on_ranges(spark, monkeypatch):
    given = docs(spark, *[f"text {i} " * (i % 9) for i in range(120)])
    want = sorted(map(tuple, lzprint.fingerprints(given).collect()))
    monkeypatch.setattr(lzprint, "RANGES", 3)
    monkeypatch.setattr(lzprint, "SAMPLE", 10)
    assert sorted(map(tuple, lzprint.fingerprints(given).collect())) == want


def test_near_duplicates_of_repeated_ids(spark):
    other = " ".join(f"o{i}" for i in range(400))
    rows = [(5, LONG), (5, other), (3, LONG + " x"), (9, other + " y"), (7, "alone")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]


def test_fingerprints_of_long_unrelated_texts():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list(letters), 1_000_000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    for t in texts:
        lzprint.phrases(t, known := set())
        assert len(known) > 100_000
    a, b = map(lzprint.fingerprint, texts)
    assert lzprint.likeness(a, b) < 0.05 and len(np.unique(a)) > 100
    assert lzprint.likeness(a, lzprint.fingerprint(texts[0][:990_000])) > 0.9


def test_preference(spark):
    kinds = "pair_id long, turn int, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", None), (None, 0, "user", "x"), (3, 0, "user", "only")], kinds)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", ""), (4, 0, "user", "other")], kinds)
    got = {r["pair_id"]: r for r in preference.format_pairs(a, b).collect()}
    assert set(got) == {1, 2}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["chosen"] == "<|assistant|>\ngood<|end|>\n"
    assert [(s["start"], s["length"], s["train"]) for s in got[1]["chosen_mask"]] == [(0, 14, False), (14, 12, True)]
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"], got[2]["chosen_mask"]) == (1, "", "", [])
    assert preference.format_pairs(a.limit(0), b).count() == 0


def test_url_rules(spark):
    urls = [("http://A.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
            ("https://x.org", "x.org", "", None, None), ("https://x.org/", "x.org", "/", "org/", "allow"), ("ftp://notorg/de/", "notorg", "/de/", None, None), (None, "", "", None, None),
            ("no scheme/x", "", "", None, None), ("http://b.com/de/1#f", "b.com", "/de/1", "com/de/", "block"), ("http://?x", "", "", None, None)]
    d = spark.createDataFrame([(i, u[0], 1) for i, u in enumerate(urls)], "page_id long, url string, host long")
    got = {r["page_id"]: r for r in urltree.judge(d).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert urltree.judge(d.limit(0)).count() == 0


def test_url_templates_generalise_and_reject(spark):
    rows = [(i, f"http://a.com/de/{i}") for i in range(40)] + [(100 + i, f"http://a.com/xx/{i}/p") for i in range(40)] + [(200 + i, f"http://b.net/de/{i}") for i in range(40)] + [(300 + i, f"http://b.net/fr/{i}") for i in range(40)] + [(400 + i, f"http://a.com/fr/{i}") for i in range(40)]
    got = {r["page_id"]: r for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5]["template"] == "/de/*" and len({got[200 + i]["template"] for i in range(40)}) == 1
    assert got[205]["verdict"] == "block" and got[305]["verdict"] == "allow"


def one_share_rather_than_two(a, n, b, m):
    """The Bayes factor in whole numbers: a share's marginal likelihood of k of n is 1 / ((n + 1) C(n, k))."""
    marginal = lambda k, n: Fraction(1, (n + 1) * math.comb(n, k))
    return marginal(a + b, n + m) / (marginal(a, n) * marginal(b, m)) >= Fraction(urltree.SIMILAR)


def brute_tree(rows):
    """Verdict, template and purity of each (host, path, label), by plain recursion over whole names."""
    split = lambda p: tuple(s for s in p.split("/") if s)
    end = lambda s: m.group(1) if (m := re.search(r"(\.[A-Za-z0-9]{1,8})$", s)) else ""
    paths = {}
    for host, path, label in rows:
        x = paths.setdefault((host, split(path)), [0, 0, 0])
        x[0], x[1], x[2] = x[0] + 1, x[1] + (label == "block"), x[2] + (label is not None)
    ways = {}

    def grow(own, k, way):
        chain = ()
        while all(len(p[1]) > k + len(chain) for p in own) and len({p[1][k + len(chain)] for p in own}) == 1:
            chain += (own[0][1][k + len(chain)],)
        k += len(chain)
        if chain:
            way = (way if way == [()] else way[:-1]) + [way[-1] + chain]
        kids = {}
        for p in own:
            if len(p[1]) == k:
                ways[p] = way
            else:
                kids.setdefault(p[1][k], []).append(p)
        n = sum(paths[p][0] for ps in kids.values() for p in ps)
        wild = len(kids) >= urltree.VARIED and 2 * len(kids) > n
        sib = {}
        for seg, ps in kids.items():
            sib.setdefault(f"*{end(seg)}" if wild else seg, []).extend(ps)
        groups, to = {}, {name: name for name in sib}
        for name, ps in sib.items():
            b, m = (sum(paths[p][i] for p in ps) for i in (1, 2))
            below = [p[1][k + 1] if len(p[1]) > k + 1 else None for p in ps]
            shape = frozenset("" if x is None else ("#" if x[0] in "0123456789" else "a") + (end(x) if len(p[1]) == k + 2 else "") for x, p in zip(below, ps, strict=True))
            if m:
                groups.setdefault(shape, []).append((Fraction(b + 1, m + 2), m, b, name))
        for g in groups.values():
            own_, last = [], None
            for x in sorted(g):
                a, m = (sum(y[2] for y in own_[-1]), sum(y[1] for y in own_[-1])) if own_ else (0, 0)
                if own_ and (x[:3] == last or one_share_rather_than_two(a, m, x[2], x[1])):
                    own_[-1].append(x)
                else:
                    own_.append([x])
                last = x[:3]
            for cluster in own_:
                for x in cluster:
                    to[x[3]] = min(y[3] for y in cluster)
        after = {}
        for name, ps in sib.items():
            after.setdefault(to[name], []).extend(ps)
        for name, ps in after.items():
            grow(ps, k + 1, [*way, way[-1] + (name,)])

    for host in {h for h, _ in paths}:
        grow([p for p in paths if p[0] == host], 0, [()])
    over, within = {}, {}
    for p, (_, b, m) in paths.items():
        for node in ways[p]:
            for t, key in ((over, node), (within, (p[0], node))):
                x = t.setdefault(key, [0, 0])
                x[0], x[1] = x[0] + b, x[1] + m
    share = (over[()][0] + urltree.PRIOR / 2) / (over[()][1] + urltree.PRIOR)
    out = {}
    for p in paths:
        q = share
        for b, m in [over[n] for n in ways[p]] + [within[p[0], n] for n in ways[p]]:
            q = (b + urltree.PRIOR * q) / (m + urltree.PRIOR) if m else q
        out[p] = "".join(f"/{x}" for x in ways[p][-1]), q
    return {(h, p, lab): (lab or ("block" if out[h, split(p)][1] > urltree.REJECT else "allow"), *out[h, split(p)]) for h, p, lab in rows}


@pytest.mark.parametrize("local", [60, urltree.LOCAL])
def test_url_tree_against_brute_force(spark, monkeypatch, local):
    """Deep and repeated paths, suffixes, empty hosts, similar and different branches, and the real pages."""
    monkeypatch.setattr(urltree, "LOCAL", local)
    rng = np.random.default_rng(14)
    urls = [None, None, "no scheme", "http:///only/path", "http://a.com", "http://a.com/", "http://a.com//x///y"]
    urls += [f"http://a.com/{'/'.join('abcdefgh')}/{rng.choice(['de', 'fr'])}/{i}" for i in range(40)]
    urls += [f"http://deep.net/{'/s' * (i % 10)}/{i % 9}" for i in range(200)]
    urls += [f"http://b.com/{rng.choice(['de', 'fr', 'xx'])}/{rng.choice(['p', 'q'])}/{i}.{rng.choice(['html', 'jpg'])}" for i in range(150)]
    urls += [f"http://s.example.org/{w}/{rng.choice(['es', 'en'])}/{i}" for w in "klmn" for i in range(20)] + ["http://s.example.org/k/es/1"] * 30
    urls += [f"http://example.org/{rng.choice(['es', 'en'])}/{i}" for i in range(60)] + [f"http://c.com/{'de' if i % 5 < 2 else 'fr'}/{i % 4}" for i in range(60)]
    urls += [f"http://c.com/{'de/' if i % 5 < 3 else 'fr/'}{i}/" + "x" * 3000 for i in range(30)]
    urls += [f"http://comb.com/{'/'.join('c' * (i + 1))}/{w}" for i in range(20) for w in ('end', 'stop')] + [f"http://t.com/{w}/{i}" for w in ('de', 'fr') for i in (1, 3, 5)]
    urls += [f"http://one.com/{'/'.join(f'd{k}' for k in range(300))}/{i}" for i in range(3)]
    real = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    for given in (urls, real) if local > 60 else (urls,):
        d = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("node", F.lit(1)).withColumn("segs", F.lit(2))
        got = urltree.judge(d).collect()
        label = {r["page_id"]: r["verdict"] if r["rule"] else None for r in got}
        want = brute_tree([(r["host"], r["path"], label[r["page_id"]]) for r in got])
        assert len(got) == len(given)
        for r in got:
            verdict, template, p = want[r["host"], r["path"], label[r["page_id"]]]
            assert (r["verdict"], r["template"]) == (verdict, template) and abs(r["purity"] - p) < 1e-9


def test_url_tree_does_not_grow_with_depth(spark):
    """Deep chains take no rounds: the jobs of 300 segments are those of four."""
    def jobs(depth):
        d = spark.createDataFrame([(i, f"http://x.net/{'/'.join(f's{k}' for k in range(depth))}/{i}") for i in range(20)], "page_id long, url string")
        group = f"depth{depth}"
        spark.sparkContext.setJobGroup(group, group)
        got = {r["template"] for r in urltree.judge(d).collect()}
        assert len(got) == 1
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(300) <= jobs(4) + 2


def test_branches_are_merged_by_their_counts():
    one = urltree.one_share
    assert one(39, 100, 41, 100) > 0 > one(10, 100, 60, 100) and one(0, 1, 1, 1) < 0 < one(1, 1, 1, 1)


def test_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    x = [*base, *(base[:20] + 0.05 * rng.normal(size=(20, 16))), *(base[0] + 0.02 * rng.normal(size=(300, 16))), base[1], base[1]]
    rows = [(i, v.tolist(), int(i % 2 if i < 40 else 0)) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] + [1.0] * 15, 0), (905, base[0].tolist(), None), (906, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(axis=1).tolist()
    top = list(range(len(x)))
    for _ in range(50):
        top = [min([top[i], *(top[j] for j in np.flatnonzero(link[i]))]) for i in range(len(x))]
    assert [got[i]["component_id"] for i in range(len(x))] == top
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    near = vectors.collide(np.sqrt(2 - 2 * 0.93))
    depth, tables = vectors.plan(10**6)
    assert (1 - near**depth) ** tables <= vectors.MISS


def test_toxicity_features_equal_plain_matching():
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abc"), int(rng.integers(1, 6)))) for _ in range(40)]
    whole = {w: float(i + 1) for i, w in enumerate(words[:8])}
    starts = {w[:3]: 2.5 for w in words if len(w) > 3}
    phrases = tuple(tuple(p) for p in {(words[i], words[i + 1]) for i in range(0, 20, 3)})
    lex = toxicity.Lexicon(whole, starts, phrases)
    for _ in range(50):
        text = list(rng.choice(words, int(rng.integers(0, 30))))
        spared = {j for i in range(len(text)) for p in phrases if tuple(text[i : i + 2]) == p for j in (i, i + 1)}
        total = sum(max([whole.get(w, 0.0), *(x for s, x in starts.items() if w.startswith(s))]) for i, w in enumerate(text) if i not in spared)
        want = (math.log1p(total), math.log1p(100 * total / len(text))) if text else (0.0, 0.0)
        assert np.allclose(toxicity.features(text, lex.automaton()), want)


def test_toxicity_learns_by_plain_odds(spark):
    """Terms, weights and exceptions against counts by hand, with ties, null ids, repeated rows and a very long text."""
    bad, rows = "vilest", []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"w{(i * 7 + j) % 50}" for j in range(12)] + ([bad] if toxic else []) + (["pond", bad] if i % 4 == 1 and i % 3 == 0 else [])
        rows.append((i, " ".join(words), int(toxic)))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, bad), (5, rows[5][1]), (900, "word " * 200_000)], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("toxic", F.lit(2))
    lab = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    lex = toxicity.learn(d, lab)
    place = {r["doc_id"]: r["p"] for r in lab.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)).alias("p")).collect()}
    fit = [(t.split(), y) for i, t, y in [*rows, rows[5]] if place[i] % 4]
    nt, nc = sum(y for _, y in fit) + 1, sum(1 - y for _, y in fit) + 1
    want = {}
    for term in {f"{w} " for ws, _ in fit for w in ws} | {w[:n] for ws, _ in fit for w in ws for n in toxicity.PREFIXES if len(w) > n}:
        held = [y for ws, y in fit if any(w == term[:-1] if term[-1] == " " else w.startswith(term) and len(w) > len(term) for w in ws)]
        t, c = sum(held), len(held) - sum(held)
        w = math.log((t + 0.5) / nt) - math.log((c + 0.5) / nc)
        if t >= toxicity.LEAST_DOCS and w >= toxicity.LEAST_ODDS:
            want[term] = w
    got = {f"{k} ": v for k, v in lex.words.items()} | lex.starts
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    s = toxicity.score(d, lex)
    assert s.count() == d.count() and s.where("score is null or score < 0 or score > 1").isEmpty()
    assert s.where("doc_id = 5").distinct().count() == 1 and toxicity.score(d.limit(0), lex).count() == 0


def test_fingerprints_against_an_independent_parse(spark):
    """Likeness within its error of the exact share of common phrases; null and repeated doc_ids, clashing names."""
    def parse(t):
        tree, out, at = {}, set(), 0
        while at < len(t):
            node, end = tree, at
            while end < len(t) and t[end] in node:
                node, end = node[t[end]], end + 1
            if end < len(t):
                node[t[end]] = {}
            out.add(t[at : end + 1])
            at = end + 1
        return out

    rng = np.random.default_rng(22)
    def text(letters, n):
        return "".join(rng.choice(list(letters), n))

    shared = text("abcdefgh", 60_000)
    texts = [shared + text("abcdefgh", 20_000), shared + text("ijkl", 40_000), text("XYZ", 300_000), "", "aaaa" * 50, "bb" * 60]
    ids = [1, 2, 3, None, 7, 7]
    d = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("own", F.lit(2))
    rows = lzprint.fingerprints(d).collect()
    order = [3, 0, 1, 2, 4, 5]  # null first, then by doc_id
    got = {(r["doc_id"], r["n_chars"]): r for r in rows}
    assert len(rows) == 6
    for k, i in enumerate(order):
        nxt = texts[order[(k + 1) % 6]]
        t, half = texts[i], len(texts[i]) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = parse(t), parse(e), parse(nxt)
        r = got[ids[i], len(t)]
        for near, x in ((r["near_edited"], b), (r["near_next"], c)):
            exact = len(a & x) / len(a | x) if a | x else 1.0
            assert abs(near - exact) < 0.15, (i, near, exact)
    assert got[2, 100_000]["near_next"] == 0.0  # no character in common


def test_packing_edge_cases(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    d = spark.createDataFrame([(1, "same text here.", 3)] * 4 + [(None, None, 4)], "doc_id long, text string, length int").withColumn("schema", F.lit("x"))
    rows = packing.pack(d, path).collect()
    n = len(Tokenizer.from_file(path).encode("same text here.", add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in rows) == 4 * n + 1 and {r["schema"] for r in rows} == {"x"}
    assert packing.pack(d.limit(0), path).count() == 0


def test_preference_ties_and_long_turns(spark):
    kinds = "pair_id long, turn int, role string, text string, n int, a string"
    long = "x" * 200_000
    a = spark.createDataFrame([(1, 0, "user", "b", 1, ""), (1, 0, "user", "a", 1, ""), (1, 0, "user", "a", 1, ""), (1, 1, "assistant", long, 1, "")], kinds)
    b = spark.createDataFrame([(1, 0, "user", "a", 2, "z"), (1, 0, "user", "a", 2, "z"), (1, 0, "user", "b", 2, "z"), (1, 1, "assistant", long + "y", 2, "z")], kinds)
    out = preference.format_pairs(a, b)
    r = out.withColumn("m", preference.mask_text("chosen_mask")).first()
    assert r["n_prompt_turns"] == 3 and r["prompt"].count("<|user|>") == 3 and r["m"] == f"0+14f 14+{len(long) + 8}t"
    for side in ("chosen", "rejected"):
        spans = r[f"{side}_mask"]
        assert sum(s["length"] for s in spans) == len(r[side]) and r[side][spans[1]["start"] :].startswith("x")


def test_vector_sketches_lose_no_link(spark):
    """Pairs just over the threshold, in vectors of large and of tiny components, and a group of many near copies."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(60):
        x = rng.normal(size=24) * 10.0 ** int(rng.integers(-100, 100)) if k % 2 else np.eye(24)[k % 24] + 1e-3 * rng.normal(size=24)
        y = rng.normal(size=24)
        u = x / np.linalg.norm(x)
        y -= (y @ u) * u
        c = vectors.THRESHOLD + (1e-9 if k % 3 else -1e-9)
        rows += [(2 * k, x.tolist(), k), (2 * k + 1, (c * u + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist(), k)]
    base = rng.normal(size=24)
    rows += [(1000 + i, (base + 0.01 * rng.normal(size=24)).tolist(), 99) for i in range(300)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for k in range(60):
        near = k % 3 > 0
        assert (got[2 * k]["n_links"], got[2 * k + 1]["component_id"]) == (int(near), 2 * k if near else 2 * k + 1)
    assert all(got[1000 + i]["n_links"] == 299 and got[1000 + i]["component_id"] == 1000 for i in range(300))


def test_vectors_of_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    d = spark.createDataFrame([(None, v, 0, 1), (5, v, 0, 1), (5, v, 0, 1), (3, v, 0, 1), (8, w, 0, 1), (8, w, 1, 1)], "vec_id long, embedding array<double>, label int, key int").withColumn("node", F.lit(1)).withColumn("x", F.lit(2))
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(d).collect()), key=str)
    assert got == sorted([(0, 3, None, True), (5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (8, 0, 8, True), (8, 0, 8, True)], key=str)


def test_anchors_over_blocks(monkeypatch):
    """Every start has one entry, whatever the blocks; equal strings have equal names."""
    rng = np.random.default_rng(23)
    data = np.frombuffer(("".join(rng.choice(list("abcdef"), 3000)) * 2 + "ab" * 700).encode(), np.uint8)
    def name_of():
        h, times, lo, hi = repeats.anchors(data)
        assert lo[0] == 0 and hi[-1] == len(data) - 400 and (lo[1:] == hi[:-1] + 1).all() and (times > 0).all()
        return np.repeat(h, hi - lo + 1)

    whole = name_of()
    monkeypatch.setattr(repeats, "BLOCK", 257)
    assert (name_of() == whole).all() and (whole[:2600] == whole[3000:5600]).all()
    assert repeats.anchors(np.full(5000, 65, np.uint8))[1].sum() > 1


def test_anchors_of_many_texts_at_once(monkeypatch):
    """Short texts share a block, so their number costs no array operations of its own; each has the anchors it has alone."""
    rng = np.random.default_rng(31)
    texts = [rng.integers(97, 103, int(n), dtype=np.uint8).tobytes() for n in rng.integers(0, 900, 600)] + [b"z" * 700, b"", b"ab" * 50_000, b"q" * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([str(i).encode() for i in range(len(texts))])], ["data", "key"])
    calls, block = [], repeats._anchors
    monkeypatch.setattr(repeats, "_anchors", lambda *x: calls.append(1) or block(*x))
    got = [(int(r["key"]), r["anchors"]) for b in repeats._sampled(200)(iter([batch.slice(0, 300), batch.slice(300)])) for r in b.to_pylist()]
    assert len(calls) < 20 and [k for k, _ in got] == list(range(len(texts)))
    for (_, own), t in zip(got, texts, strict=True):
        name, times, lo, hi = repeats.anchors(np.frombuffer(t, np.uint8), 200)
        assert [(a["name"], a["times"], a["lo"], a["hi"]) for a in own] == list(zip(*(x.tolist() for x in (name.view(np.int64), times, lo, hi)), strict=True))


def test_starts_are_compared_by_both_hashes_within_groups():
    h, g, group = np.array([7, 7, 7, 7, 7, 8, 9, 9], np.uint64), np.array([1, 2, 1, 3, 1, 1, 4, 4], np.uint64), np.array([0, 0, 0, 0, 1, 0, 1, 2])
    assert repeats._repeated(h, g, group).tolist() == [True, False, True, *[False] * 5]
    assert repeats._repeated(h[[0, 2, 5]], g[[0, 2, 5]], group[[0, 2, 5]]).tolist() == [True, True, False]


def test_near_duplicates_with_clashing_names(spark):
    d = docs(spark, *TEXTS[:3])
    for c in ("node", "n", "sig", "band", "comp", "hashes", "size"):
        d = d.withColumn(c, F.lit(1))
    assert [r["component_id"] for r in neardup.near_duplicates(d).orderBy("doc_id").collect()] == [0, 0, 0]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Null and odd rows, and extra columns with the names of the operators' own, among real documents."""
    import corpus_pipeline

    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    passage = " ".join(f"shared{i}" for i in range(80))
    odd = [None, "", " \t", "x" * 3000, " ".join(f"p{i}" for i in range(90)) + " " + passage, " ".join(f"q{i}" for i in range(90)) + " " + passage, *[LONG] * 3]
    rows = [(d, t, s, len(t or "")) for d, t, s in real + [(100_000 + i, t, None if i % 2 else "web") for i, t in enumerate(odd)]]
    clash = ["a", "b", "size", "taken", "turn", "key", "range", "n_removed", "kept_text", "data", "start", "length", "kept", "node"]
    kinds = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in clash)
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(*r, *range(len(clash))) for r in rows], kinds).write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/sf/labels.parquet")
    sf, before = f"{tmp_path}/sf", spark.read.parquet(f"{tmp_path}/sf/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        nonlocal before
        stages[name](spark, before, sf).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == before.columns
        assert all([r[c] for c in clash] == list(range(len(clash))) for r in out.select(*clash).collect())
        old, before = before.select("doc_id", "text").collect(), out
        return {r["doc_id"]: r["text"] for r in old}, [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]

    old, new = after("toxicity")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = old.keys() - dict(new).keys()
    assert len(gone - toxic) <= 0.05 * len(old) and all(old[d] == t for d, t in new)
    old, new = after("near_dedup")
    ids = sorted(old)
    assert sorted(d for d, _ in new) == [ids[i] for i, (_, top) in enumerate(brute_near([old[d] for d in ids])) if top == i]
    old, new = after("repeats")
    want = {d: (n, sha) for d, (_, n, _, sha) in zip(old, brute_repeats(old.values(), corpus_pipeline.PASSAGE), strict=True)}
    for d, t in new:
        if t is not None and all(ord(c) < 128 for c in old[d]):
            assert hashlib.sha256(t.encode()).hexdigest() == want[d][1]
    left = dict(new)
    assert all(want[d][0] > 0 for d in old.keys() - left.keys()) and not left[100_004].endswith("shared79")
    old, new = after("mixing")
    words = Counter()
    for d, t in new:
        words[d] += len((t or "").split())
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/repeats")).collect() if r["taken"]}
    assert dict(words) == taken
    pieces = stages["packing"](spark, before, sf).collect()
    assert sum(r["doc_tokens"] for r in pieces if r["start"] == 0) == sum(r["length"] for r in pieces)
    assert sum(r["start"] == 0 for r in pieces) == len(new)


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


ALIGNED = ["hello  world", "<s>x</s> <0x41> é😀 \n\ttab<|endoftext|>", "a▁b", " lead", "", None, "nul\0 and \x07", "x" * 5_000, "the cat the cat", "the cat the cat",
           "Straße über naïve ﬁne 漢字かな " * 40, " ", "\n", "ends "]


def brute_alignment(texts):
    """All of an alignment's columns by walking over every byte."""
    e = align.Encoders(queries.BYTE_LEVEL, queries.PIECES)
    docs, holding = [], Counter()
    for t in texts:
        (x,), (y,) = e.encode([t or ""])
        owner_a = [i for i, k in enumerate(x) for _ in e.bytes_a[k]]
        owner_b = [i for i, k in enumerate(y) for _ in e.bytes_b[k]]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, mine, its = [], [], []
        for p in range(len(owner_a)):
            ends = [p + 1 == len(o) or o[p + 1] != o[p] for o in (owner_a, owner_b)]
            for done, ids, o, all_ids in ((ends[0], mine, owner_a, x), (ends[1], its, owner_b, y)):
                if done:
                    ids.append(str(all_ids[o[p]]))
            if all(ends):
                groups.append(f"{','.join(mine)}|{','.join(its)}")
                mine, its = [], []
        docs.append((len(x), len(y), groups, [(x[i], y[k]) for i, k in links]))
        holding.update(set(docs[-1][3]))
    best = {}
    for (i, _), n in holding.items():
        best[i] = max(best.get(i, 0), n)
    for n_a, n_b, groups, links in docs:
        text = ";".join(groups)
        yield (n_a, n_b, len(groups), len(links), sum(holding[p] == best[p[0]] for p in links), sum(holding[p] for p in links),
               hashlib.sha256(text.encode()).hexdigest() if n_a else "", text)


@pytest.mark.parametrize("chunk", [40, align.CHUNK])
def test_alignment_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    monkeypatch.setattr(align, "BATCH", chunk)
    given = docs(spark, *ALIGNED).withColumn("n_a", F.lit("own")).withColumn("pair", F.lit(1))
    got = {r["doc_id"]: tuple(r)[1:] for r in align.align(given, queries.BYTE_LEVEL, queries.PIECES, groups=True).collect()}
    assert [got[i] for i in range(len(ALIGNED))] == list(brute_alignment(ALIGNED))
    assert got[2] == got[4] == got[5] == (0, 0, 0, 0, 0, 0, "", "")


def test_alignment_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "the cat"), (1, "the cat"), (1, "the dog"), (None, None)], "doc_id long, text string")
    got = Counter(tuple(r) for r in align.align(rows, queries.BYTE_LEVEL, queries.PIECES).drop("groups_sha256").collect())
    want = [(i, *w[:6]) for i, w in zip((None, 1, 1, None), brute_alignment(["the cat", "the cat", "the dog", None]), strict=True)]
    assert got == Counter(want)
    assert align.align(rows.limit(0), queries.BYTE_LEVEL, queries.PIECES).count() == 0


def test_gallop():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3_000):
        ends = np.cumsum(rng.integers(1, 9, n))
        values = np.sort(rng.integers(1, ends[-1] + 1, 200))
        guess, low, high = rng.integers(0, n, 200), np.zeros(200, int), np.full(200, n - 1)
        assert (align.gallop(values, ends, guess, low, high) == np.searchsorted(ends, values)).all()


def brute_clusters(rows, k, rounds, size):
    """Plain rounds over Python integers: (vec_id, cluster, distance), sums and hashes."""
    x = [(i, [math.floor(256 * float(np.float32(v))) for v in e]) for i, e in rows
         if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in x]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(x, own, strict=True) if c == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = assign()
    inertia = Counter()
    for d, c in own:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(x, own, strict=True))


@pytest.mark.parametrize(("k", "pivots", "n"), [(5, 2, 120), (40, 40, 12)])
def test_clusters_against_brute_force(spark, k, pivots, n):
    rng = np.random.default_rng(n + k)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=6) + i % 3)]) for i in range(n)]
    rows += [(n, rows[0][1]), (3, rows[3][1]), (None, rows[1][1]), (None, [0.0] * 6), (n + 1, None), (n + 2, [1.0]), (n + 3, [None, *[1.0] * 5]), (n + 4, [float("nan")] * 6), (n + 5, [float("inf")] * 6)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS x", "3 AS label").repartition(3)
    got = Counter(tuple(r) for r in simplex.cluster(given, k=k, pivots=pivots, size=6).collect())
    assert got == brute_clusters(rows, k, 5, 6)


def test_clusters_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) * (3e5 if i % 20 == 0 else 10.0 ** (i % 3))).astype(np.float32).astype(float).tolist()) for i in range(60)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in simplex.cluster(given, k=5, size=6).collect()) == brute_clusters(rows, 5, 5, 6)
    huge = spark.createDataFrame([*rows, (90, [1e15] * 6), (91, [-1e15] * 6), (92, [1e30] * 6)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["distance"] for r in simplex.cluster(huge, k=2, size=6).collect()}
    assert sorted(got) == [*range(60), 90, 91] and None in (got[90], got[91])


def test_clusters_of_equal_or_no_vectors(spark):
    same = [(i, [0.5] * 4) for i in range(9)]
    given = spark.createDataFrame(same, "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in simplex.cluster(given, k=3, size=4).collect()) == brute_clusters(same, 3, 5, 4)
    assert simplex.cluster(given, size=5).count() == 0
    assert simplex.cluster(given.limit(0)).columns == simplex.cluster(given, size=4).columns


def test_simplex_bounds_hold():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-300, 300, (500, 16)), rng.integers(-300, 300, (30, 16))
    for most in (1, 3, 12, 30):
        p = simplex.Projection(c, most)
        a, b = p.apexes(x), p.apexes(c)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        hull = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
        assert (hull + (a[:, None, -1] - b[None, :, -1]) ** 2 <= d + 1e-3).all()
        assert (hull + (a[:, None, -1] + b[None, :, -1]) ** 2 >= d - 1e-3).all()
        who, dist, n = simplex.nearest(x, a, c, b)
        assert (who == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all() and n <= 500 * 30
    assert n < 500 * 30 / 2  # with pivots that span the space the bounds decide most


def page(body, *around):
    lines = "".join(f"<div>{x}</div>" for x in around)
    return f"<html><head><title>t</title></head><body>{lines}{body}</body></html>"


def own_lines(k, n=6):
    return [" ".join(f"w{k}x{j}x{i}" for i in range(12)) for j in range(n)]


def brute_lcs(a, b):
    """Places of a in one longest common subsequence, by the whole table; only its length is unique, so tests use lines that occur once."""
    size = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1, j + 1] = size[i, j] + 1 if a[i] == b[j] else max(size[i, j + 1], size[i + 1, j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif size[i - 1, j] >= size[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


@pytest.mark.parametrize("tasks", [1, 7])
def test_main_text_by_differences(spark, monkeypatch, tasks):
    monkeypatch.setattr(pagediff, "tasks_for", lambda t: tasks)
    rows, lines, menu, rng = [], {}, ["Home", "All topics", "About us"], np.random.default_rng(5)
    for k in range(40):
        host, path = f"h{k % 3}.example", f"/a/{int(rng.integers(1000)):04}"
        own = own_lines(k)
        around = [menu[0], menu[1], f"Site of {host}", menu[2]]
        lines[k] = (host, path, [*around, *own, f"Edition {k % 2}"])
        rows.append((k, f"https://{host}{path}?q={k}", page("".join(f"<p>{x}</p>" for x in own) + f"<div>Edition {k % 2}</div>", *around)))
    got = {r["page_id"]: r["text"] for r in pagediff.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()}
    for host in {x[0] for x in lines.values()}:
        order = sorted((path, k) for k, (h, path, _) in lines.items() if h == host)
        for i, (_, k) in enumerate(order):
            mine, gone = lines[k][2], set()
            for j in (i - 1, i + 1):
                if 0 <= j < len(order):
                    gone |= brute_lcs(mine, lines[order[j][1]][2])
            assert got[k] == "\n".join(x for i, x in enumerate(mine) if i not in gone)
            assert own_lines(k)[0] in got[k] and "Home" not in got[k]


def test_main_text_of_marked_pages_and_copies(spark):
    article = "<article><h1>A &amp; B</h1><p>one<br>two  &eacute;</p><p>Licensed under X.</p><aside>read also</aside></article>"
    body = f"<nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use <b>cookies</b></div>{article}<section id=comments><article><p>first!</article></section><footer>&copy; x</footer>"
    copy = page("".join(f"<p>{x}</p>" for x in own_lines(1)), "Home")
    rows = [(0, "http://x.example/1", body), (1, "http://x.example/2", body), (2, None, None), (3, "no url", ""), (4, "http://y.example/1", copy), (5, "http://y.example/2", copy),
            (6, "http://z.example/", "<p>cut &amp"), (7, "http://z.example/", "<p>x" + "<b>y</b> " * 60_000), (8, "http://z.example/", "text <a hre"), (None, "http://z.example/9", "<p>n")]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS row", "2 AS host", "'t' AS text", "0 AS lines")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pagediff.main_texts(given).collect()}
    want = "A & B\none two é\nLicensed under X."
    assert got[0] == got[1] == (want, len(want))
    assert got[2] == got[3] == ("", 0)
    assert got[4][0] == got[5][0] == "\n".join(["Home", *own_lines(1)])
    assert got[6][0] == "cut &" and got[8][0] == "text" and got[None] == ("n", 1)
    assert got[7][0] == "x" + " ".join(["y"] * 60_000)
    assert pagediff.main_texts(given.limit(0)).count() == 0


@pytest.mark.parametrize("kept", [1 << 26, 8])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, kept):
    monkeypatch.setattr(pagediff, "ROWS_KEPT", kept)
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(0, 5, int(rng.integers(0, 14))).tolist() for _ in range(2))
        got = sorted(pagediff.shared_places(a, b))
        rest = iter(b)
        assert len(got) == len(brute_lcs(a, b)) and all(a[i] in rest for i in got)


def test_main_text_of_the_given_pages(spark):
    """Their articles are what lies between the article tags, a block a line."""
    def plain(html):
        inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(x for x in blocks if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in pagediff.main_texts(pages).collect()} == want
