"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from helpers import DOC_SCHEMA, awkward, awkward_rows, words
from pyspark.sql.functions import col as spark_col

from strandloom.llm import _shared, decontam, htmltext, langid, lmscore, merkle, mixing, pii, queries, ring, simhash, tokenbin
from strandloom.llm._shared import RangeBuckets


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def run(spark, name, sf_dir):
    return queries.queries()[name](spark, sf_dir).collect()


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# language identification


def test_langid_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = run(spark, "op1_langid", sf)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98


def test_langid_scores_equal_a_plain_sum(docs, texts):
    model = langid.fit(docs)
    some = [texts[i] for i in sorted(texts)[:20]] + ["ab", "ß"]
    _, scores = model.predict(some)
    for text, got in zip(some, scores):
        points = np.array([ord(c) for c in text.lower()] + [10] * 2, np.uint32)
        total = model.prior.copy()
        for order in langid.ORDERS:
            for b in langid._buckets(points, order)[: len(text.lower())]:
                total = total + model.log_prob[b]
        share = np.exp((total - total.max()) / langid.SCALE)
        assert got == pytest.approx(share.max() / share.sum())


def test_langid_long_text_is_scored_in_pieces(docs, texts, monkeypatch):
    model, text = langid.fit(docs), " ".join(texts[i] for i in sorted(texts)[:30])
    whole = model.predict([text])
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert model.predict([text])[0] == whole[0] and model.predict([text])[1] == whole[1]


@pytest.mark.parametrize("gathered", [1, 50, 4000])
def test_langid_scores_some_n_grams_at_a_time(docs, texts, monkeypatch, gathered):
    model, some = langid.fit(docs), [texts[i] for i in sorted(texts)[:6]] + ["ab", None, "ß", ""]
    some = [t and t[:300] for t in some]
    whole = model.predict(some)
    monkeypatch.setattr(langid, "GATHERED", gathered)
    got = model.predict(some)
    assert got[0] == whole[0] and np.array_equal(got[1], whole[1])


def plain_buckets(text, order):
    """The hash of each n-gram that begins in a text, in whole numbers."""
    points, out = [ord(c) for c in text] + [10] * (max(langid.ORDERS) - 1), []
    for i in range(len(text)):
        h = order
        for p in points[i : i + order]:
            h = (h ^ p) * 0x9E3779B1 % (1 << 32)
            h ^= h >> 15
        out.append(h * 0x85EBCA77 % (1 << 32) >> 16)
    return out


def test_langid_fit_and_prediction_by_brute_force(spark, sf_dir, docs):
    """Counts, smoothing, prior, held-out rows and prediction without the operator."""
    rows = [(r["doc_id"], (r["text"] or "")[:400], r["lang"]) for r in docs.collect()]
    some = spark.createDataFrame(rows + [(None, "nul id", "zz"), (9**9, "x", None)], "doc_id long, text string, lang string")
    train = [(t, lang) for d, t, lang in rows if lang is not None and zlib.crc32(str(d).encode()) % 5]
    langs = sorted({lang for _, lang in train})
    counts = {lang: Counter() for lang in langs}
    for t, lang in train:
        for order in langid.ORDERS:
            counts[lang].update(plain_buckets(t.lower(), order))
    n = Counter(lang for _, lang in train)
    model = langid.fit(some)
    assert model.languages == tuple(langs)
    log_prob = {lang: {} for lang in langs}
    for i, lang in enumerate(langs):
        whole = sum(counts[lang].values()) + 0.1 * langid.BUCKETS
        assert model.prior[i] == round(np.log(n[lang] / len(train)) * langid.SCALE)
        for b in range(0, langid.BUCKETS, 97):
            assert model.log_prob[b, i] == round(np.log((counts[lang][b] + 0.1) / whole) * langid.SCALE)
        log_prob[lang] = lambda b, c=counts[lang], whole=whole: round(np.log((c[b] + 0.1) / whole) * langid.SCALE)
    got = {r["doc_id"]: r for r in langid.identify(some).collect()}
    for d, t, _ in rows[:40]:
        grams = [b for order in langid.ORDERS for b in plain_buckets(t.lower(), order)]
        sums = {lang: round(np.log(n[lang] / len(train)) * langid.SCALE) + sum(map(log_prob[lang], grams)) for lang in langs}
        if re.search(r"[^\W\d_]", t):
            assert got[d]["lang_pred"] == max(langs, key=sums.get)
            assert got[d]["score"] == pytest.approx(1 / sum(np.exp((x - max(sums.values())) / langid.SCALE) for x in sums.values()))


def test_langid_very_long_text(spark, docs, texts):
    text = next(t for t in texts.values() if t and len(t) > 500)
    rows = [(1, text, "en"), (2, text * 4000, "en")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.fit(docs)).collect()}
    assert got[1] == got[2]


def test_langid_awkward(spark):
    got = {(r["doc_id"], i): r for i, r in enumerate(langid.identify(awkward(spark)).collect())}
    assert len(got) == len(awkward_rows())
    for (doc_id, _), r in got.items():
        if doc_id in (2, 3, 6, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    kept = langid.keep_identified(awkward(spark))
    assert kept.columns == awkward(spark).columns and {2, 3, 6, 9}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first()["lang_pred"] == "und"


# fingerprints


def tree(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out, tops = [], []
    for section in re.split(r"(?<=\n)(?=\n)", text):
        lines, own = [], []
        for line in section.split("\n"):
            leaves = [sha(line[i : i + merkle.BLOCK]) for i in range(0, len(line), merkle.BLOCK)]
            h = sha("P" + "".join(leaves))
            lines.append(h)
            own += ["P" + h[:10], *["L" + x[:10] for x in leaves]]
        h = sha("S" + "".join(lines))
        tops.append(h)
        out += ["S" + h[:10], *own]
    return " ".join([sha("D" + "".join(tops)), *out])


def near(a, b):
    if a.split()[0] == b.split()[0]:
        return 1.0
    x, y = ({n for n in f.split() if n[0] == "L"} for f in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def check_fingerprints(got, ordered):
    """ordered: (doc_id, text) in the order of ids."""
    assert len(got) == len(ordered)
    want = Counter()
    for (doc_id, text), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(text) // 4
        changed = text[: len(text) - k] + nxt[:k]
        a, b = tree(text), tree(changed)
        want[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, tree(nxt)), 9)] += 1
    have = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    assert have == want


def test_merkle(spark, sf_dir, texts):
    got = run(spark, "op2_merkle", sf_dir)
    check_fingerprints(got, sorted(texts.items()))
    assert np.mean([r["near_edited"] for r in got]) > 0.3 > np.mean([r["near_next"] for r in got])


@pytest.mark.parametrize("rows_each", [1, 2, 250])
def test_merkle_awkward_and_ranges(spark, rows_each, monkeypatch):
    plain = RangeBuckets.of
    monkeypatch.setattr(RangeBuckets, "of", staticmethod(lambda df, key, each: plain(df, key, rows_each)))
    ordered = sorted(((r[0], r[1] or "") for r in awkward_rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    check_fingerprints(merkle.fingerprints(awkward(spark)).collect(), ordered)
    assert merkle.fingerprints(empty(spark)).count() == 0


def test_merkle_locates_edits(spark):
    from pyspark.sql import functions as F

    a, b = "one\ntwo\n\nthree", "one\n2\n\nthree"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.differing_branches(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d")).first()
    kinds = [x[0] for x in row["d"][1:]]
    assert kinds == ["S", "P", "L"]


# sharding


def test_ring(spark, sf_dir, texts):
    rows = run(spark, "op3_ring", sf_dir)
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1


def plain_ring(ids, shards):
    """Shard and slot of each id, one id at a time."""
    signed = lambda h: h - (1 << 64) * (h >> 63)
    first = {d: xxhash.xxh64_intdigest(struct.pack("<q", d), 42) for d in ids}
    second = {d: signed(xxhash.xxh64_intdigest(struct.pack("<i", 1), h)) for d, h in first.items()}
    cell = {d: signed(h) % ring.CELLS for d, h in first.items()}
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    points = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(ring.VNODES))
    spots = [(h * ring.CELLS >> 64, s) for h, s in points]
    out = {}
    for d in sorted(ids, key=lambda d: (cell[d], second[d], d)):
        clockwise = [s for c, s in spots if c >= cell[d]] + [s for _, s in spots]
        s = next(s for s in clockwise if room[s])
        out[d] = (s, len([x for x in out.values() if x[0] == s]))
        room[s] -= 1
    return out


def test_ring_query_by_brute_force(spark, sf_dir, texts):
    want = plain_ring(list(texts), 16)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in run(spark, "op3_ring", sf_dir)} == want


def test_ring_rows_without_an_id_fill_no_cell(spark):
    docs = spark.range(2000).selectExpr("cast(null as bigint) as doc_id", "concat('text ', id) as text")
    raw = docs.selectExpr("doc_id", "cast(length(text) + 1 as bigint) as size", "crc32(cast(text as binary)) as crc")
    most = raw.groupBy(ring.cell_of(raw.doc_id, raw["size"], raw.crc).alias("c")).count().agg({"count": "max"}).first()[0]
    assert most < 10
    rows = ring.shard(docs, 4).collect()
    assert Counter(r["shard"] for r in rows) == {s: 500 for s in range(4)} and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(500)) for s in range(4))


def test_ring_flow_equals_a_walk_of_single_keys():
    counts = {c: n for c, n in [(3, 5), (40, 1), (41, 30), (900, 14), (16000, 9)]}
    for slack in (0.0, 0.3):
        spans = ring.flow(counts, 4, slack)
        total = sum(counts.values())
        room = [int(np.ceil((1 + slack) * total / 4))] * 4 if slack else [total // 4 + (s < total % 4) for s in range(4)]
        points, used, want = ring.points(4), [0] * 4, []
        for cell in sorted(counts):
            for k in range(counts[cell]):
                clockwise = [s for c, s in points if c >= cell] + [s for _, s in points]
                s = next(s for s in clockwise if used[s] < room[s])
                want.append((cell, k, s, used[s]))
                used[s] += 1
        have = sorted((c, k, s, base + k - lo) for c, lo, hi, s, base in spans for k in range(lo, hi))
        assert have == sorted(want)


def test_ring_moves_few_rows_with_slack():
    counts = {c: 3 for c in range(0, ring.CELLS, 4)}

    def owners(n, slack):
        return {(c, k): s for c, lo, hi, s, _ in ring.flow(counts, n, slack) for k in range(lo, hi)}

    a, b = owners(16, 0.25), owners(17, 0.25)
    assert sum(a[x] != b[x] for x in a) / len(a) < 0.25


def test_ring_awkward(spark):
    rows = ring.shard(awkward(spark), 4).collect()
    assert len(rows) == len(awkward_rows())
    assert sorted(Counter(r["shard"] for r in rows).values()) == [2, 3, 3, 3]
    assert ring.shard(empty(spark), 4).count() == 0


# token ids


@pytest.mark.parametrize("width", [1, 5, 13, 16, 17, 24, 31])
def test_packing_round_trip(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 31, 32, 33, 5000):
        ids = r.integers(0, 1 << width, n, dtype=np.uint32)
        assert np.array_equal(tokenbin.unpack(tokenbin.pack(ids, width), n, width), ids)


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenbin.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_encoder_equals_the_tokenizer():
    odd = ["", " ", "a  b   c", "\n\n x\n", "don't we'll I'm", "tab\there  \t x", "nbsp a b", "end  \n", "a<|endoftext|> b", "1 23  4.5e6", "é😀 中文 字", "\x1c a\x85 b", " lead", "x y z", "a ​ b"]
    made = tokenbin.Encoder(tokenbin.default_tokenizer())
    for _ in range(2):
        for text, want in zip(odd, whole_ids(odd)):
            assert np.frombuffer(made(text), "<u4").tolist() == want[:-1], repr(text)
    got = dict(made.many(odd * 3))
    assert [got[i].tolist() for i in range(len(odd) * 3)] == [x[:-1] for x in whole_ids(odd)] * 3


def test_encoder_cuts_for_plain_byte_level_tokenizers_alone():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other, plain = tokenbin.Encoder(path), Tokenizer.from_file(path)
    assert not other.cuts and tokenbin.Encoder(tokenbin.default_tokenizer()).cuts
    odd = ["Hello  World's end", "A.b,c", "", "x" * 300, "Ünï code 1 23"]
    got = dict(other.many(odd))
    assert [got[i].tolist() for i in range(len(odd))] == [plain.encode(x, add_special_tokens=False).ids for x in odd]


def check_tokens(got, ordered):
    start, want = 0, []
    for (doc_id, _), ids in zip(ordered, whole_ids([t for _, t in ordered])):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    have = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda x: x[1])
    assert [x[0] for x in have] == [x[0] for x in want] and Counter(have) == Counter(want)


def test_tokenbin(spark, sf_dir, texts):
    check_tokens(run(spark, "op4_tokenbin", sf_dir), sorted(texts.items()))


def test_tokenbin_awkward(spark):
    ordered = sorted(((r[0], r[1]) for r in awkward_rows()), key=lambda x: (x[0] is not None, x[0] or 0, np.array(whole_ids([x[1]])[0], "<u2").tobytes()))
    check_tokens(tokenbin.tokenised(awkward(spark), tokenbin.default_tokenizer()).collect(), ordered)
    assert tokenbin.tokenised(empty(spark), tokenbin.default_tokenizer()).count() == 0


@pytest.mark.parametrize("at_once", [1, 64])
def test_file_random_access(tmp_path, at_once, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(tokenbin, "BLOCKS_AT_ONCE", at_once)

    r, files = np.random.default_rng(3), fs.LocalFileSystem()
    docs = [(i, r.integers(0, 50_000, n, dtype=np.uint32)) for i, n in enumerate([0, 1, 9000, 4096, 3])]
    writer = tokenbin.FileWriter(files.open_output_stream(str(tmp_path / "x")), 16)
    for d in docs:
        writer.add(*d)
    writer.close()
    reader = tokenbin.FileReader(files.open_input_file(str(tmp_path / "x")))
    for i in (4, 2, 0, 3, 1):
        assert np.array_equal(reader.document(i), docs[i][1])
    for ids_at_once in (1, 5000, 1 << 20):
        assert [(d, x.tolist()) for d, x in reader.documents(ids_at_once)] == [(d, x.tolist()) for d, x in docs]
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-5])
    with pytest.raises(ValueError):
        tokenbin.FileReader(files.open_input_file(str(tmp_path / "y")))


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check_base(rows, by_key):
    for r in rows:
        want = plain_spans(by_key[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert r["spans"] == listed or r["spans"].startswith((listed + ",generalised:", listed + ",removed:"))


def test_pii(spark, texts, sf_dir):
    rows = run(spark, "op5_pii", sf_dir)
    assert len(rows) == len(texts)
    check_base(rows, texts)


def test_pii_patterns_equal_their_plain_forms(spark):
    import random

    r = random.Random(4)
    parts = ["a@b.c", "@", ".", "-", " ", "1.2.3.4", "255.256.1.1", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "5500000000000004", "+1 (555) 010-9999", "+", "é", "😀", "x_y", "..", "\n", "9" * 12, "a.b%c+d@e-f.g.h.", "(", ")", "00"]
    texts = {i: "".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for i in range(1500)}
    texts |= {2000: "1" * 30_000 + " " + "1 " * 20_000, 2001: "a" * 50_000 + "@" + "b." * 20_000, 2002: "1." * 20_000, 2003: "+1" + "-" * 30_000}
    rows = pii.personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)


LETTERS = str.maketrans("0123456789", "abcdefghij")


def leaking():
    """Noise, texts with one address and a word of its own, and one with that word alone."""
    noise = [(i, "the one lives near here and there " + words(60, i).replace("w", "word").translate(LETTERS)) for i in range(100, 160)]
    leaks = [(i, f"{words(5, i)} the one lives near zanzibar{'abcdefg'[i]} Zanzibar x{i}y and {words(3, 50 + i)} joe@corp.example.org {words(4, 70 + i)} the") for i in range(7)]
    return noise, leaks, (7, "zanzibar alone has nothing to protect")


@pytest.mark.parametrize("common", [2, 1000])
def test_pii_terms(spark, common, monkeypatch):
    """With terms and entities that are joined as common ones, and without."""
    monkeypatch.setattr(_shared, "COMMON", common)
    noise, leaks, alone = leaking()
    both = spark.createDataFrame([*noise, *leaks, alone], "doc_id long, text string")
    rows = pii.personal_data(both).collect()
    got = {r["doc_id"]: r["spans"] for r in rows}
    for i, text in leaks:
        spots = {x.split(":", 1)[1] for x in got[i].split(",") if x.startswith(("generalised", "removed"))}
        marked = {text[int(a) : int(b)] for a, b in (x.split(":") for x in spots)}
        assert "Zanzibar" in marked and not marked & {"the", "one", "lives", "near"}
    assert got[7] == "" and all(got[i] == "" for i, _ in noise)
    assert all((r["n_generalised"], r["n_removed"]) == (r["spans"].count("generalised:"), r["spans"].count("removed:")) for r in rows)
    clean = {r["doc_id"]: r["clean"] for r in pii.sanitise(both).collect()}
    assert all("[EMAIL]" in clean[i] and "Zanzibar" not in clean[i] and "joe@" not in clean[i] and "lives near" in clean[i] for i, _ in leaks)
    assert clean[7] == alone[1] and clean[100] == noise[0][1]


def test_pii_both_decisions(spark):
    """A word of one address in many contexts is removed, one seen once generalised."""
    noise = [(i, words(66, i).replace("w", "word").translate(LETTERS)) for i in range(10_000, 10_500)]
    many = [(1000 + i, f"{words(9, 300 + i).translate(LETTERS)} zanzibar {words(9, 400 + i).translate(LETTERS)} joe@corp.example.org") for i in range(60)]
    some = [(2000, "once qwertyx here ann@other.example.net")]
    rows = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame([*noise, *many, *some], "doc_id long, text string")).collect()}
    text = dict(many)[1005]
    assert f"removed:{text.index('zanzibar')}:{text.index('zanzibar') + 8}" in rows[1005]["spans"]
    assert "generalised:5:12" in rows[2000]["spans"]


def test_pii_copies_are_one_context(spark):
    """A thousand copies of a text show no more than one."""
    noise, _, _ = leaking()
    text = "some qwertyx words here ann@other.example.net"
    for copies in (1, 300):
        docs = spark.createDataFrame([*noise, *[(1000 + i, text) for i in range(copies)]], "doc_id long, text string")
        found = pii.find(docs).where("doc_id = 1000").first()["terms"]
        assert all(x["kind"] == "generalised" for x in found)


def test_pii_finds_terms_on_the_tables_and_spares_clean_documents(spark):
    rows = run(spark, "op5_pii", "/root/testdata/sf0.01")
    touched = [r for r in rows if r["n_generalised"] + r["n_removed"]]
    assert len(touched) > 0 and all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in touched)


def test_pii_awkward(spark):
    rows = pii.personal_data(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows)
    assert got[1, 1, 0, 0, 1] == 1 and got[None, 0, 1, 1, 0] == 1
    assert pii.sanitise(awkward(spark)).count() == len(awkward_rows())
    assert pii.personal_data(empty(spark)).count() == 0


# mixing


def test_targets():
    got = mixing.targets([("a", 10), ("b", 1000), (None, 0), ("c", 100)])
    assert got["a"] == 20 and got[None] == 0 and sum(got.values()) == pytest.approx(1.5 * 1110)
    assert got["c"] == 200 and got["b"] == pytest.approx(1665 - 220)
    assert mixing.targets([]) == {}


def test_mixing(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows, again = run(spark, "op6_mixing", sf), run(spark, "op6_mixing", sf)
    assert Counter(rows) == Counter(again) and len(rows) == len(docs)
    sizes, taken, target, most = Counter(), Counter(), {}, Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = r["target"]
        most[d["source"]] = max(most[d["source"]], r["size"])
    assert target == pytest.approx(mixing.targets(list(sizes.items())))
    assert all(abs(taken[s] - target[s]) <= max(0.08 * target[s], most[s]) for s in sizes)
    assert all(r["source_size"] == sizes[docs[r["doc_id"]]["source"]] for r in rows)


def test_targets_of_many_sources(spark):
    """By sums over a table, as on the driver."""
    r = random.Random(3)
    sizes = [(f"s{i}", r.choice((0, 1, 5, 40, 900))) for i in range(200)] + [(None, 7), ("ü", 3)]
    want = mixing.targets(sizes)
    table = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes], "is_null boolean, name string, n long").repartition(5)
    got = mixing.distributed_targets(table, Fraction(3, 2), 2, mixing.WEIGHTS).collect()
    assert len(got) == len(sizes)
    assert {None if x["is_null"] else x["name"]: x["target"] for x in got} == pytest.approx(want)
    assert mixing.distributed_targets(table.limit(0), Fraction(3, 2), 2, mixing.WEIGHTS).count() == 0
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 30}") for i in range(400)], "doc_id long, text string, source string")
    same = lambda **x: Counter((d["doc_id"], d["copies"], round(d["target"], 6)) for d in mixing.mix(docs, **x).collect())
    assert same(driver_sources=3) == same()


def test_mixing_cells_grow_with_the_table(spark, monkeypatch):
    assert [mixing.subcells(n) for n in (0, 10**6, 16 * 10**5, 16 * 10**5 + 1, 10**9)] == [32, 32, 32, 64, 32768]
    docs = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "cast(null as string) as source")
    for each in (50_000, 20):
        monkeypatch.setattr(mixing, "ROWS_EACH", each)
        rows = mixing.mix(docs).collect()
        assert len(rows) == 4000 and sum(r["copies"] for r in rows) == 6000 and {r["copies"] for r in rows} == {1, 2}


def test_mixing_awkward(spark):
    rows = mixing.mixed(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows()) and all(r["taken"] <= 2 * r["size"] for r in rows)
    out = mixing.emit(awkward(spark))
    assert out.columns == awkward(spark).columns
    assert out.count() == sum(r["copies"] for r in mixing.mix(awkward(spark)).collect())
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.emit(empty(spark)).count() == 0
    assert mixing.targets([("x", 4)], Fraction(3, 2)) == {"x": 6.0}


# pages


def test_html_article():
    page = """<html><head><title>T</title><script>var a="</p>";</script><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <header><h1>Site</h1></header><article><header><h1>Title &amp; more</h1></header><p>First <b>bo</b>ld&nbsp;text.<br><p><b>Second
      para<form>name</form><aside>Related</aside><div class="ad">Buy</div>Third<!-- no --><ul><li>One</li></ul><section id="comments"><article>Nice</article></section></article>
    <div class=sidebar>Side</div><footer>&copy; me</footer>"""
    assert htmltext.extract(page) == "Title & more First bold text. Second para Third One"


def test_html_without_article():
    good = "The house of the man was in the middle of the town and it was not for sale at that time. " * 2
    page = f"<body><div><a href=1>Links and</a> <a href=2>more links</a></div><div><h2>A title</h2><p>{good}</p><p>Yes.</p><p>{good}</p></div><div><ul><li><a href=3>The one of the many in the list that is long enough to count here</a></li></ul></div><div>{'Buy cheap stuff now. ' * 9}</div>"
    got = htmltext.extract(page)
    assert got.count("house") == 4 and "Yes." in got and "A title" in got and "inks" not in got and "cheap" not in got and "list" not in got


def test_html_article_is_no_filter():
    good = "The house of the man was in the middle of the town and it was not for sale at that time. " * 2
    teaser = "<article><h3>More</h3><p>A short teaser</p></article>"
    got = htmltext.extract(f"<body><div><h2>A title</h2><p>{good}</p><p>{good}</p></div>{teaser}<div class=sidebar><p>{good}</p></div>")
    assert got.count("house") == 4 and "A title" in got
    # Text beside an article, and after one that was closed too early.
    got = htmltext.extract(f"<body><article><p>{good}</p></article><div><p>{good}</p></div><p>{'Buy cheap stuff now. ' * 9}</p>")
    assert got.count("house") == 4 and "cheap" not in got
    # Long blocks without stop words go with their neighbours within an article.
    got = htmltext.extract(f"<article><p>{good}</p><p>{'qwx zrt plk ' * 9}</p><p>{good}</p></article>")
    assert got.count("house") == 4 and "zrt" in got


def test_html_of_another_language():
    good = "Był dom przy drodze, ktoś mieszkał tam wiele lat, nikt nie pamiętał kiedy zbudowano jego mury. "
    links = "".join(f"<li><a href={i}>Odnośnik numer kolejny strony głównej {i}</a></li>" for i in range(4))
    got = htmltext.extract(f"<body><div class=menu>{good}</div><div><h2>Tytuł</h2><p>{good}</p><p>Tak.</p><p>{good}</p></div><p>{'<a href=1>' + good + '</a>'}</p><ul>{links}</ul>")
    assert got.count("ktoś") == 2 and "Tytuł" in got and "Tak." in got and "Odnośnik" not in got


GOOD = "The house of the man was in the middle of the town and it was not for sale at that time. " * 2


@pytest.mark.parametrize("name", ["content no-sidebar", "page has-sidebar", "with-menu", "site-header-fixed wrap", "ad-free", "side-by-side", "widget", "alert", "banner", "page-header"])
def test_html_wrappers_empty_no_page(name):
    """No class around the whole page takes its text away."""
    for inner in (f"<article><h1>Title</h1><p>{GOOD}</p></article>", f"<h1>Title</h1><p>{GOOD}</p>"):
        got = htmltext.extract(f'<body><div class="{name}">{inner}<div class="sidebar"><p>Aside: {GOOD}</p></div><div class="comments"><p>Reader: {GOOD}</p></div></div><div class="site-footer"><p>Foot {GOOD}</p></div>')
        assert got.count("house") == 2 and "Title" in got and "Aside" not in got and "Reader" not in got and "Foot" not in got
    nested = f'<div class="widget"><div class="banner">{GOOD}</div></div><div class="cookie-notice">{GOOD}{GOOD}</div>'
    assert htmltext.extract(nested).count("house") == 2
    assert htmltext.extract(f'<div class="comments">{GOOD}</div><div class="ad-slot-2">{GOOD}</div>') == ""


def test_html_article_keeps_its_parts():
    got = htmltext.extract(f'<article><p>{GOOD}</p><section class="related-work"><h2>Related work</h2><p>Others {GOOD}</p></section><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p><a href=1>The report of the committee on that house</a></p><p>{GOOD}</p><ul class="related-posts"><li><a href=2>More of the same</a></li></ul></article>')
    assert "Related work Others" in got and "So x=2 holds." in got and "The report of the committee" in got and "More of" not in got


def test_html_density_and_neighbours_decide(monkeypatch):
    """Without either pass the text of a page without an article is another."""
    page = f"<body><div><h2>Heading</h2><p>{GOOD}</p><p>Yes.</p><p>{GOOD}</p></div><div class=x><p>{'Buy cheap stuff now. ' * 9}</p><p>Now.</p></div>"
    whole = htmltext.extract(page)
    assert "Heading" in whole and "Yes." in whole and "cheap" not in whole and "Now." not in whole
    with monkeypatch.context() as m:
        m.setattr(htmltext, "STOP_DENSITY", 0.0)
        assert "cheap" in htmltext.extract(page)
    found, named = htmltext.blocks(page)
    alone = " ".join(b.text for b, good in zip(found, htmltext.first_pass(found, named)) if good)
    assert alone.count("house") == 4 and "Heading" not in alone and "Yes." not in alone


def test_html_labels_equal_a_plain_second_pass():
    """Random pages: each undecided block by a search of its part."""
    r = random.Random(6)
    parts = [f"<p>{GOOD}</p>", "<p>short one</p>", "<h2>head</h2>", f"<p>{'Buy cheap stuff now. ' * 9}</p>", "<article>", "</article>", "<div>", "</div>", "<section class=share>", "</section>", "<aside>x</aside>", "<p><a href=1>linked text</a></p>", "<nav><p>menu</p></nav>"]
    for _ in range(300):
        found, named = htmltext.blocks("".join(r.choice(parts) for _ in range(r.randrange(1, 25))))
        first = htmltext.first_pass(found, named)
        for i, got in enumerate(htmltext.labels(found, named)):
            if first[i] is not None:
                assert got == first[i]
                continue
            near = sorted((abs(j - i), j > i, first[j]) for j in range(len(found)) if first[j] is not None and found[j].part == found[i].part)
            sides = [next((x for x in near if x[1] == s), None) for s in (False, True)]
            known = [x for x in sides if x]
            if not known:
                want = found[i].main
            elif len({x[2] for x in known}) == 1:
                want = known[0][2]
            elif found[i].heading:
                want = sides[1][2]
            else:
                want = found[i].main if sides[0][0] == sides[1][0] else min(known)[2]
            assert got == want


def test_html_awkward_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, lang string"
    long = "<article>" + f"<p>{GOOD}</p>" * 4000 + "</article>"
    rows = [(1, "u", None, "t", "n", None), (None, None, "", "t", "n", None), (2, "u", f"<p>{GOOD}</p>", None, None, "x"), (2, "u", f"<p>{GOOD}</p>", None, None, "x"), (3, "v", long, "t", "n", "x")]
    out = htmltext.extracted(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    text = " ".join(GOOD.split())
    want = [(1, "u", "", 0), (None, None, "", 0), *[(2, "u", text, len(text))] * 2, (3, "v", " ".join([text] * 4000), 4000 * (len(text) + 1) - 1)]
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)
    assert htmltext.extracted(spark.createDataFrame([], schema)).count() == 0


def test_html_deep_pages_take_little_time():
    import time

    begin = time.time()
    htmltext.extract("<div class=widget>" * 20_000 + "x" + "</section>" * 20_000)
    htmltext.extract("".join(f"<div class=widget><p>{GOOD}" for _ in range(2000)))
    assert time.time() - begin < 20


def test_html_pages(spark, sf_dir):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.on, self.out = False, []

        def handle_starttag(self, tag, attrs):
            self.on |= tag == "article"
            self.out.append(" " if tag in ("p", "h1", "br") else "")

        def handle_endtag(self, tag):
            self.on &= tag != "article"
            self.out.append(" " if tag in ("p", "h1") else "")

        def handle_data(self, data):
            if self.on:
                self.out.append(data)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = run(spark, "op7_htmltext", sf_dir)
    assert len(rows) == len(pages)
    for r in rows:
        p = Article()
        p.feed(pages[r["page_id"]])
        p.close()
        assert r["text"] == " ".join("".join(p.out).split()) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page", [None, "", "<", "a < b", "<p", "<!-- open", "<script>x", "</div></div>x", "<div " * 2000, "<p>" * 20000 + "x", "</svg>" * 9, "<a href='x>" * 50, "<head><p>q</p>"])
def test_html_awkward(page):
    assert isinstance(htmltext.extract(page), str)


# near duplicates


def simhash_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (doc_id, fingerprint); the component of each fingerprint."""
    least = {}
    for d, f in fps:
        least[f] = d if least.get(f) is None else least[f] if d is None else min(d, least[f])
    keys = np.array(sorted(least), np.uint64)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 4):
            root[find(int(j))] = find(i)
    name = {}
    for i, k in enumerate(keys):
        x, r = least[int(k)], find(i)
        name[r] = x if name.get(r) is None else name[r] if x is None else min(x, name[r])
    return {int(k): name[find(i)] for i, k in enumerate(keys)}


def test_simhash(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = [(d, simhash_of(t)) for d, t in texts.items()]
    of = brute_components(fps)
    want = {d: (f"{f:016x}", of[f]) for d, f in fps}
    rows = run(spark, "op8_simhash", sf)
    assert len(rows) == len(want) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


@pytest.mark.parametrize("hot", [3, 40, 4096])
def test_simhash_links_lose_nothing(spark, hot):
    r = np.random.default_rng(hot)
    centres = r.integers(0, 1 << 64, 25, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres[:20]:
        for _ in range(60):
            f = int(c)
            for b in r.integers(0, 64, r.integers(1, 6)):
                f ^= 1 << int(b)
            fps.add(f)
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    of = brute_components([(s, s & (1 << 64) - 1) for s in signed])
    roots = simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot))
    got = {x: x for x in signed} | {x["node"]: x["root"] for x in roots.collect()}
    assert got == {s: of[s & (1 << 64) - 1] for s in signed}


def plain_wide(texts):
    """Component (smallest doc_id) of each document, by comparing all pairs."""
    prints = {}
    for d, t in texts:
        h = [x for _, g in _shared.word_hashes([t]) for x in g]
        prints[d] = simhash.wide_fingerprint_of(h[0] if h else np.zeros(0, np.uint64))
    size = {}
    for low, high, n in prints.values():
        size[low, high] = max(n, size.get((low, high), 0))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, x in prints.items():
        for b, y in prints.items():
            near = bin(x[0] ^ y[0]).count("1")
            bands = [int(simhash.band(np.array([size[p[:2]]]))[0]) for p in (x, y)] if a < b and near <= 10 else [0, 9]
            if near + bin(x[1] ^ y[1]).count("1") <= 20 and abs(bands[0] - bands[1]) <= 1:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: find(d) for d in prints}


def altered(text, share, r):
    w = text.split()
    for _ in range(max(1, round(len(w) * share))):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("hot,run", [(7, 2), (1 << 14, 3), (1 << 14, 256)])
def test_keep_one_by_brute_force(spark, hot, run, monkeypatch):
    """By hot keys in blocks, by long runs, and by short ones."""
    monkeypatch.setattr(simhash, "LONG_RUN", run)
    links = simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda fps: links(fps, hot))
    r = random.Random(hot + run)
    base = [words(r.choice((3, 40, 200, 400)), i, 5000) for i in range(25)]
    texts = base + [altered(t, r.choice((0.005, 0.01, 0.02, 0.05)), r) for t in base for _ in range(4)] + [base[0]] * 3 + [None, "", " ", "a b", "a b"]
    texts = list(enumerate(texts))
    want = plain_wide(texts)
    got = simhash.wide_grouped(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == len(texts) and {x["doc_id"]: x["component_id"] for x in got} == want
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(set(want.values()))


@pytest.mark.parametrize("hot", [40, 1000])
def test_dense_groups_are_dealt_once(spark, hot):
    """Near copies under one key: rows dealt for comparison follow the number of rows."""
    r = np.random.default_rng(hot)
    low, high = (int(x) for x in r.integers(0, 1 << 63, 2, dtype=np.uint64))
    rows, far = {(low, high)}, set()
    while len(rows) < 700:
        x = low
        for b in r.integers(16, 64, 4):
            x ^= 1 << int(b)
        rows.add((x, high ^ 1 << int(r.integers(0, 64))))
    while len(far) < 30:  # the same segment, other bits elsewhere
        far.add((low & 0xFFFF | int(r.integers(0, 1 << 47)) << 16, int(r.integers(0, 1 << 63))))
    signed = [(int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64)), 100) for a, b in sorted(rows | far)]
    fps = spark.createDataFrame(signed, "low long, high long, size long")
    got = {x["node"]: x["root"] for x in simhash.components(simhash.wide_links(fps, hot)).collect()}
    node = lambda xs: simhash._node(*(np.array(c, np.uint64) for c in zip(*xs))).view(np.int64).tolist()
    members = node(sorted(rows))
    assert {got.get(x, x) for x in members} == {min(members)}
    assert not set(node(sorted(far))) & set(got)
    if hot == 40:
        near_rows = spark.createDataFrame([(1, *x[:2], 1, i) for i, x in enumerate(signed[:400])], "key long, low long, high long, near long, rank long")
        assert simhash._wide_block_pairs(near_rows, 40).count() == 0
        few = near_rows.unionByName(near_rows.where("rank < 5").selectExpr("key", "low", "high", "0L as near", "rank"))
        assert simhash._wide_block_pairs(few, 40).count() == 400 + 5 * 11


def test_long_runs_and_short_ones_connect_the_same():
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 64, (40, 2), dtype=np.uint64)
    rows = []
    for low, high in centres:
        for _ in range(25):
            x = [int(low), int(high)]
            for b in r.integers(0, 128, r.integers(0, 14)):
                x[b // 64] ^= 1 << int(b % 64)
            rows.append(x)
    low, high = np.array(rows, np.uint64).T.copy()
    keys, start = np.zeros(len(low), np.int64), np.full(len(low), 2)
    found = []
    for run in (10**9, 1):
        simhash.LONG_RUN, before = run, simhash.LONG_RUN
        try:
            a, b = simhash._wide_compare(keys, low, high, start)
        finally:
            simhash.LONG_RUN = before
        found.append(dict(zip(a.tolist(), b.tolist())))
    assert found[0] == found[1] and len(found[0]) > 100


def test_keep_one_finds_pairs_of_a_similarity_of_0_8():
    """Recall by similarity of the sets of five words; unlike texts stay apart."""
    r, seen = random.Random(8), {}
    for i in range(1500):
        a = words(r.randrange(60, 500), i, 20_000)
        b = altered(a, r.choice((0.004, 0.008, 0.012, 0.016, 0.02, 0.03)), r)
        (x, y) = (simhash.wide_fingerprint_of(next(_shared.word_hashes([t]))[1][0]) for t in (a, b))
        near = bin(x[0] ^ y[0]).count("1")
        linked = near <= 10 and near + bin(x[1] ^ y[1]).count("1") <= 20
        seen.setdefault(int(jaccard(a, b) * 20) / 20, []).append(linked)
    share = {j: sum(x) / len(x) for j, x in seen.items() if len(x) >= 20}
    print({j: round(x, 2) for j, x in sorted(share.items())})
    assert share[0.95] > 0.98 and share[0.9] > 0.9 and share[0.8] > 0.4
    assert all(x < 0.25 for j, x in share.items() if j < 0.7)


def test_components_of_long_paths(spark):
    n = 200
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n)} | {1001: 1000}


def test_components_of_an_ascending_path_take_few_rounds(spark, monkeypatch):
    rounds = []
    write = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: (rounds.append(label), write(df, label))[1])
    n = 300
    edges = spark.createDataFrame([(i - 150, i - 149) for i in range(n - 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i - 150: -150 for i in range(1, n)}
    assert rounds.count("moves") <= 20


def test_components_have_one_row_for_each_node(spark):
    r = random.Random(0)
    edges = [(1, 2), (2, 3)] + [(100 * g + i, 100 * g + r.randrange(i)) for g in range(1, 30) for i in range(1, r.randrange(3, 12))]
    nodes = {x for e in edges for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    rows = simhash._contracted(df).collect()
    assert len(rows) == len({x["node"] for x in rows}) and all(x["node"] != x["root"] for x in rows)
    assert len(rows) == len(nodes) - 30
    rows = simhash.components(df).collect()
    assert sorted((x["node"], x["root"]) for x in rows) == sorted((n, n // 100 * 100 or 1) for n in nodes if n % 100 and n != 1)


def test_simhash_one_row_for_each_document(spark, monkeypatch):
    """Groups of 3 to 12 distinct fingerprints, some with copies."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text: text.cast("bigint"))
    r, fps = random.Random(4), []
    for g in range(12):
        centre = r.getrandbits(63)
        near = {centre} | {centre ^ sum(1 << b for b in r.sample(range(63), 4)) for _ in range(2 + g % 10)}
        fps += [f for f in sorted(near) for _ in range(r.randrange(1, 3))]
    of = brute_components(list(enumerate(fps)))
    docs = spark.createDataFrame([(i, str(f)) for i, f in enumerate(fps)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert Counter((x["doc_id"], x["component_id"]) for x in rows) == Counter((i, of[f]) for i, f in enumerate(fps))


def test_simhash_common_keys(spark, monkeypatch):
    monkeypatch.setattr(_shared, "COMMON", 2)
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(r.choice(words, 60)) for _ in range(20)]
    texts += [texts[0]] * 30 + [texts[1] + f" w{i}" for i in range(8)] + [None] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = brute_components([(i, simhash_of(t)) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: of[simhash_of(t)] for i, t in enumerate(texts)}


def test_simhash_awkward(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    of = brute_components([(r[0], simhash_of(r[1])) for r in awkward_rows()])
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == Counter((x[0], f"{simhash_of(x[1]):016x}", of[simhash_of(x[1])]) for x in awkward_rows())
    kept = [simhash.keep_one(awkward(spark), n) for n in (0, 500_000)]
    assert kept[0].columns == awkward(spark).columns
    assert Counter(kept[0].collect()) == Counter(kept[1].collect())
    assert simhash.near_duplicates(empty(spark)).count() == 0


# decontamination


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item_id, item in items:
        x = plain_words(item)
        k = min(8, len(x))
        grams = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if grams else 0):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


def check_hits(rows, texts, items):
    have = Counter(tuple(r) for r in rows)
    want = Counter((d, *plain_hits(t, items)) for d, t in texts)
    assert have == want


@pytest.fixture(scope="module")
def tricky():
    base = words(30, 3, 60)
    items = [(1, base), (2, "Short Item é"), (3, words(9, 5, 60)), (4, None), (5, "!!"), (6, "Short Item é"), (2, words(8, 9, 60)), (10, "one")]
    texts = [(0, base), (1, "x " + " ".join(base.split()[4:16]).upper() + " y"), (2, "a short, ITEM é! short item É"), (3, None), (4, ""), (5, words(9, 5, 60) + " " + words(8, 9, 60) + " one"), (5, "one"), (5, "one"), (None, "one two"), (6, " ".join(base.split()[:7])), (7, words(5000, 8, 60))]
    return texts, items


@pytest.mark.parametrize("set_size,bits", [(7, 1 << 24), (200_000, 1 << 24), (200_000, 64)])
def test_decontam_tricky(spark, tricky, set_size, bits, monkeypatch):
    """By a shuffle, by a broadcast, and with a bitmap that is nearly full."""
    texts, items = tricky
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    plain = decontam.scan
    monkeypatch.setattr(decontam, "scan", lambda d, b: plain(d, b, set_size=set_size))
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    check_hits(decontam.contamination(d, b).collect(), texts, items)


def test_decontam_of_200_000_windows(spark):
    """They are one literal of the plan, so planning takes seconds."""
    import time

    item = lambda i: " ".join(f"q{i}x{j}" for j in range(107))
    b = spark.range(2000).selectExpr("id as item_id", "array_join(transform(sequence(0, 106), j -> concat('q', id, 'x', j)), ' ') as text")
    texts = [(i, words(50, i) + " " + " ".join(item(i).split()[20 : 20 + i]) + " end") for i in range(12)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    begin = time.time()
    rows = decontam.contamination(d, b).collect()
    assert time.time() - begin < 60
    check_hits(rows, texts, [(i, item(i)) for i in range(12)])
    assert decontam.windows(b).count() == 200_000


def test_decontam(spark, sf_dir, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    check_hits(run(spark, "op9_decontam", sf_dir), texts.items(), items)


def test_decontaminate(spark, tricky):
    texts, items = tricky
    schema = "doc_id long, text string, n_chars long, hits string, copies int"
    d = spark.createDataFrame([(i, t, None if t is None else len(t), "h", 1) for i, t in texts], schema)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(d, b)
    assert out.columns == d.columns
    assert Counter(out.collect()) == Counter(decontam.decontaminate(d, b, broadcast_hits=0).collect())
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())
    for i, t in texts:
        _, n_hit, n_items, _, gone = plain_hits(t, items)
        mine = [x for x in got if x[0] == i]
        if gone:
            assert all(x[1] != t for x in mine)
        elif not n_hit:
            assert (i, t, None if t is None else len(t)) in got
    assert (1, "x y", 3) in got and (None, "two", 3) in got
    assert all(plain_hits(x[1], items)[1] == 0 for x in got)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(d, nothing).count() == len(texts) and decontam.contamination(d.limit(0), b).count() == 0


def test_decontam_awkward(spark):
    b = spark.createDataFrame([(1, "same text twice"), (2, "text of id eight")], "item_id long, text string")
    check_hits(decontam.contamination(awkward(spark), b).collect(), [(r[0], r[1]) for r in awkward_rows()], [(1, "same text twice"), (2, "text of id eight")])


# language-model scores


def test_lm_learns_from_both_sides(spark):
    import random

    r = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]

    def sentence():
        k = r.randrange(20)
        return f"the {nouns[k]} {verbs[k]} a {nouns[(k * 7) % 20]} ."

    docs = [(i, " ".join(sentence() for _ in range(60))) for i in range(150)]
    shuffled = []
    for i, t in docs[:30]:
        w = t.split()
        r.shuffle(w)
        shuffled.append((1000 + i, " ".join(w)))
    train = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    voc = lmscore.vocabulary(train)
    net = lmscore.train(lmscore.encoded(train, voc), voc, 20)
    both = spark.createDataFrame(docs[:30] + shuffled, "doc_id long, text string")
    got = {x["doc_id"]: x["mean_log_prob"] for x in lmscore.score(both, voc, net).collect()}
    assert all(got[i] > got[1000 + i] + 0.5 for i in range(30))


def test_lm_trains_on_every_position(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    voc = lmscore.vocabulary(docs)
    biases = lmscore.train(lmscore.encoded(docs, voc), voc).wb[0]
    assert biases[:3].min() > biases[3:].max() + 0.03


def test_lm_scores_equal_a_plain_sum(spark, docs, texts):
    voc = lmscore.vocabulary(docs)
    net = lmscore.Network.fresh(voc.per_class)
    count = Counter(int(lmscore._bucket(_shared._hashes(w)[0])[0]) for t in texts.values() for w in t.encode().split())
    of_id = Counter()
    for bucket, n in count.items():
        of_id[int(voc.ids[bucket])] += n
    assert voc.words == sum(count.values()) and len(of_id) <= voc.size
    rows = lmscore.score(docs, voc, net).collect()
    for r in rows[:15]:
        buckets = [int(lmscore._bucket(_shared._hashes(x)[0])[0]) for x in texts[r["doc_id"]].encode().split()]
        ids = [int(voc.ids[x]) for x in buckets]
        pad = [voc.size] * 2
        ring_ = pad + ids + pad
        total = 0.0
        for i, (t, bucket) in enumerate(zip(ids, buckets)):
            ctx = [ring_[i], ring_[i + 1], ring_[i + 3], ring_[i + 4]]
            h = np.tanh(net.embed[ctx].ravel() @ net.w + net.b)
            c, j = divmod(t, voc.per_class)
            a, b = h @ net.cw + net.cb, h @ net.ww[c] + net.wb[c]
            total += a[c] - np.log(np.exp(a).sum()) + b[j] - np.log(np.exp(b).sum()) + np.log(count[bucket] / of_id[t])
        assert r["n_tokens"] == len(ids) and r["log_likelihood"] == pytest.approx(total, rel=1e-4)


def test_lm_vocabulary_shares():
    """Each id's words share its probability; bands of rare ones are of like mass."""
    counts = np.zeros(1 << lmscore.BUCKET_BITS, np.int64)
    counts[::7] = np.maximum(1, 200_000 // np.arange(1, len(counts[::7]) + 1))
    voc = lmscore.Vocabulary.of(counts)
    assert voc.per_class == lmscore.PER_CLASS[1] and voc.words == counts.sum()
    seen = counts > 0
    whole = np.bincount(voc.ids[seen], np.exp(voc.log_share[seen].astype(float)), minlength=voc.size)
    assert whole == pytest.approx(1, abs=1e-3)
    own = voc.size * 3 // 4
    assert np.bincount(voc.ids[seen], minlength=voc.size)[:own].tolist() == [1] * own
    mass = np.bincount(voc.ids[seen], counts[seen], minlength=voc.size)[own:]
    assert mass.max() < 1.5 * mass.min()
    assert np.isfinite(voc.log_share).all()
    assert lmscore.Vocabulary.of(np.zeros(1 << lmscore.BUCKET_BITS, np.int64)).words == 0


def plain_step(weights, seen, ctx, ids, rate=lmscore.RATE):
    """Adagrad, one position at a time, in double precision."""
    grad = {k: np.zeros_like(v) for k, v in weights.items()}
    w = {k: v.copy() for k, v in weights.items()}
    per_class = w["ww"].shape[2]
    for around, target in zip(ctx, ids):
        x = w["embed"][around].ravel()
        h = np.tanh(x @ w["w"] + w["b"])
        c, j = divmod(int(target), per_class)
        p, q = np.exp(h @ w["cw"] + w["cb"]), np.exp(h @ w["ww"][c] + w["wb"][c])
        p, q = p / p.sum(), q / q.sum()
        p[c] -= 1
        q[j] -= 1
        p, q = p / len(ids), q / len(ids)
        grad["cw"] += np.outer(h, p)
        grad["cb"] += p
        grad["ww"][c] += np.outer(h, q)
        grad["wb"][c] += q
        d = (w["cw"] @ p + w["ww"][c] @ q) * (1 - h * h)
        grad["w"] += np.outer(x, d)
        grad["b"] += d
        back = (w["w"] @ d).reshape(len(around), -1)
        for a, g in zip(around, back):
            grad["embed"][a] += g
    for k in weights:
        seen[k] += grad[k] ** 2
        weights[k] -= rate * grad[k] / (np.sqrt(seen[k]) + 1e-6)


@pytest.mark.parametrize("bounded", [False, True])
def test_lm_training_equals_plain_steps(bounded):
    r, per = np.random.default_rng(0), 32
    net, seen = lmscore.Network(per, lmscore.Network.fresh(per).flat * 3), lmscore.Network.unseen(per)
    names = net.shapes(per)
    weights, past = ({k: getattr(x, k).astype(float) for k in names} for x in (net, seen))
    for n in (50, 7, 30):
        ctx, ids = r.integers(0, 1025, (n, 4)).astype(np.uint16), r.integers(0, 300, n).astype(np.uint16)
        ctx[:, 1] = 5
        plain_step(weights, past, ctx, ids)
        net.train(ctx, ids, seen, bounded=bounded)
        for k in names:
            assert getattr(net, k) == pytest.approx(weights[k], abs=2e-4), k
    assert np.exp(net.log_prob(ctx[:1].repeat(1024, 0), np.arange(1024).astype(np.uint16))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_learns_what_it_is_shown():
    r = np.random.default_rng(0)
    net, seen = lmscore.Network(32, lmscore.Network.fresh(32).flat * 3), lmscore.Network.unseen(32)
    ctx, ids = r.integers(0, 40, (50, 4)).astype(np.uint16), r.integers(0, 80, 50).astype(np.uint16)
    before = net.log_prob(ctx, ids).mean()
    for _ in range(30):
        net.train(ctx, ids, seen)
    assert net.log_prob(ctx, ids).mean() > before + 1


def test_lm_training_equals_a_walk_of_the_shards(spark, docs, monkeypatch):
    """Rounds, shards, their order and their average, done again without Spark."""
    monkeypatch.setattr(lmscore, "SHARD_WORDS", 5000)
    voc = lmscore.vocabulary(docs)
    rows = lmscore.encoded(docs, voc)
    net = lmscore.train(rows, voc, 2)
    shards = {}
    for r in rows.where("n_tokens > 0").orderBy("shard", "doc_id", "ids").collect():
        shards.setdefault(r["shard"], []).append(np.frombuffer(r["ids"], "<u2"))
    assert len(shards) > 5
    want, whole = lmscore.Network.fresh(voc.per_class), voc.words
    for turn in range(2):
        total, n = 0.0, 0
        for texts in shards.values():
            own = lmscore.Learner(want, turn, 2)
            for t in texts:
                own.add(t)
            own.flush()
            total, n = total + own.net.flat.astype(float) * own.trained, n + own.trained
        want, whole = lmscore.Network(voc.per_class, total / n), whole - n
    assert whole == 0 and net.flat == pytest.approx(want.flat, abs=1e-6)


def test_lm_does_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lmscore, "SHARD_WORDS", 5000)
    a, b = ({r["doc_id"]: r["mean_log_prob"] for r in lmscore.score(docs.repartition(n)).collect()} for n in (2, 16))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a)
    assert np.corrcoef([a[i] for i in a], [b[i] for i in a])[0, 1] > 0.999999


def test_lm_tells_words_from_junk(spark):
    """Unknown words are less likely than rare ones, and those than frequent ones."""
    known = [(i, words(300, i, 300)) for i in range(40)]
    r = random.Random(1)
    odd = [(100, " ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(300)))]
    got = {x["doc_id"]: x["mean_log_prob"] for x in lmscore.score(spark.createDataFrame(known + odd, "doc_id long, text string")).collect()}
    assert got[100] < min(got[i] for i, _ in known) - 1


def test_lm_long_text_is_cut_at_white_space(monkeypatch):
    text = words(3000)
    whole = np.concatenate([h for _, g in _shared.word_hashes([text]) for h in g])
    monkeypatch.setattr(_shared, "PIECE", 500)
    assert np.array_equal(np.concatenate([h for _, g in _shared.word_hashes([text]) for h in g]), whole)


def test_lm_awkward(spark):
    rows = lmscore.score(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    assert all((r["n_tokens"], r["log_likelihood"], r["mean_log_prob"]) == (0, 0.0, None) for r in rows if r["doc_id"] in (2, 3, 9))
    assert all(r["log_likelihood"] < 0 for r in rows if r["n_tokens"])
    assert lmscore.score(empty(spark)).count() == 0


# work files


def test_work_files_are_removed(spark):
    import os

    def there(path):
        return os.path.exists(path.removeprefix("file://").removeprefix("file:"))

    with _shared.work_files(spark) as own:
        kept = _shared.materialize(spark.range(3), "kept", keep=True)
        gone = _shared.materialize(spark.range(4), "gone")
        assert gone.count() == 4
    assert [there(p) for p in own] == [True, False] and kept.count() == 3
    _shared.discard(spark, own)
    assert not there(own[0])


# ranges of ids


def test_ranges_grow_with_the_table():
    assert [RangeBuckets.count(n, 250) for n in (0, 249, 500, 10**6, 10**8, 10**9, 10**10, 10**11)] == [1, 1, 2, 1024, 1024, 10_000, 65_536, 65_536]


def test_ranges_give_each_key_its_bucket(spark):
    bounds = (-50, -3, 0, 4, 5, 17, 1 << 40)
    keys = [None, -60, -50, -49, -3, 0, 3, 4, 5, 16, 17, 18, 1 << 40, (1 << 63) - 1]
    ranges = RangeBuckets(bounds)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = df.select("k", ranges.index(df.k).alias("i")).select("k", "i", ranges.begins(df.k, spark_col("i")).alias("b")).collect()
    for k, i, b in got:
        assert i == max(0, sum(x <= k for x in bounds) - 1 if k is not None else 0)
        assert b == (k in bounds)


def test_decontaminate_long_text_of_one_passage(spark):
    """Time doesn't grow with the product of words and hits."""
    item = "one two three four five six seven eight nine ten"
    text = "Start. " + (item + ", kept words here. ") * 5000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = decontam.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string")).first()["text"]
    assert out == ("Start. " + "kept words here. " * 5000).strip()
