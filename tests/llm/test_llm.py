"""The training-data operators against brute force, round trips and held-out data on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyadflow.llm import arc, bpe, digest, minhash, mixing, pii, quality, queries, rans, xent
from dyadflow.llm.common import materialise, strings
from dyadflow.llm.licenses import scan_licenses

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, bucket int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    long = " ".join(f"w{i % 977}x" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", None), (4, "one", "en", "a"), (5, "One", "en", "b"), (6, long, "en", "a"), (7, long + " end", "de", "b"), (7, long + " end", "de", "b"), (None, "null id text here", "en", "a"), (9, "Σ é ́x <|endoftext|> a@b.co 1.2.3.4", "el", "a")]
    return spark.createDataFrame([(d, t, l, s, None, "?", 1) for d, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_quality_counts(spark):
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, SF).collect()}
    for d, t in texts(spark).items():
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = defaultdict(list)
        for i in range(len(words) - 2):
            places[tuple(words[i : i + 3])].append(i)
        covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_quality_odd(odd, empty):
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == odd.count() and all(r.base_failed for r in rows if r.doc_id in (1, 2, 3, 4))
    assert quality.quality_rules(empty).count() == 0


def test_sketches_merge(spark):
    rows = spark.range(2000).select(F.lit("en").alias("lang"), (F.col("id") % 3).cast("string").alias("source"), *[(F.col("id") / 100).alias(m) for m in quality.MEASURES])
    whole = quality.sketches(rows).filter("level = 'lang'").groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    parts = quality.sketches(rows).filter("level = 'source'").groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    assert whole.exceptAll(parts).count() == parts.exceptAll(whole).count() == 0


def components_by_hand(sets):
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def shingles(text, k):
    w = text.translate(LOWER).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_duplicates_by_hand(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(150)]
    rows = {}
    for i in range(120):  # edits of one text, so that some pairs link and some don't
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(150)] = f"n{rnd.random()}"
        rows[i] = " ".join(w)
    rows |= {200 + i: " ".join(base[:40] + [f"q{i}{j}" for j in range(60)]) for i in range(20)}
    rows |= {300: "", 301: "one", 302: "ONE", 303: rows[5], 304: None}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 2).collect()}
    want = components_by_hand({d: shingles(t or "", 2) for d, t in rows.items()})
    assert {d: r.component_id for d, r in got.items()} == want and all(r.kept == (d == r.component_id) for d, r in got.items())


def test_near_duplicates_odd(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 9: 9}
    assert minhash.near_duplicates(empty).count() == 0


def test_estimate_is_corrected_for_chance(spark):
    docs = spark.createDataFrame([(0, " ".join(f"a{i}" for i in range(300))), (1, " ".join(f"a{i}" for i in range(60, 360))), (2, " ".join(f"b{i}" for i in range(300)))], "doc_id long, text string")
    s = docs.select("doc_id", minhash.signer(1)("text").alias("s")).select("doc_id", "s.signature")
    pairs = s.alias("x").join(s.alias("y"), F.col("x.doc_id") < F.col("y.doc_id")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), minhash.estimate(F.col("x.signature"), F.col("y.signature")).alias("e"))
    got = {(r.a, r.b): r.e for r in pairs.collect()}
    assert abs(got[0, 1] - 240 / 360) < 0.1 and abs(got[0, 2]) < 0.1


def test_rans_round_trip():
    rnd = np.random.default_rng(5)
    ids = np.minimum(rnd.geometric(0.01, 300_000), 999)
    freq = rans.quantised(np.bincount(ids, minlength=1000)).astype("<u4")
    assert freq.sum() == 1 << rans.BITS
    symbol, crc = np.repeat(np.arange(1000, dtype=np.uint32), freq), zlib.crc32(freq.tobytes())
    for n in (0, 1, 63, 64, 65, 5000, 300_000):
        block = rans.encode_block(ids[:n], b"index", 1, freq, crc)
        back, docs = rans.decode_block(block, freq, symbol, crc)
        assert (back == ids[:n]).all() and docs == b"index"
    broken = bytearray(rans.encode_block(ids, b"", 0, freq, crc))
    broken[-1000] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), freq, symbol, crc)


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in queries.op3_rans_token_files(spark, SF).collect()}
    for d, t in sorted(texts(spark).items()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_pieces_like_the_library(odd):
    pieces = rans.pieces_of(queries.tokenizer_file("byte_bpe_50k.json"))
    rnd = random.Random(6)
    cases = [r.text or "" for r in odd.collect()] + ["".join(rnd.choice([" ", "\n", "a", "B", ".", ",", "'s", "1", "é", "　", "<|endoftext|>"]) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    ids, n = pieces.encode(strings(pa.array(cases)))
    ends = np.cumsum(n)
    for t, s, e in zip(cases, ends - n, ends, strict=True):
        assert pieces.tokenizer.encode(t, add_special_tokens=False).ids == ids[s:e].tolist(), t


def test_token_files_odd(spark, odd, empty):
    rows = rans.decode_corpus(rans.encode_corpus(odd, queries.tokenizer_file("byte_bpe_50k.json"), 50257)).collect()
    assert len(rows) == odd.count() and sum(len(r.ids) // 4 == 1 for r in rows) == 2
    assert rans.decode_corpus(rans.encode_corpus(empty, queries.tokenizer_file("byte_bpe_50k.json"), 50257)).count() == 0


def test_cross_entropy_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = xent.score_documents(docs, labels.filter("quality = 1 AND doc_id % 2 = 0"))
    held = scored.join(labels, "doc_id").filter("doc_id % 2 = 1 AND score IS NOT NULL").select("score", "quality").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([[b > g for g in good] for b in bad]) > 0.9


def test_cross_entropy_odd(odd, empty):
    rows = xent.score_documents(odd, odd.filter("doc_id = 6")).collect()
    assert len(rows) == odd.count() and all(r.score is None for r in rows if r.doc_id in (1, 2, 3))
    assert xent.score_documents(empty, empty).count() == 0


def test_warc_round_trip(spark):
    rows = [(3, "http://a b/", "same"), (1, None, "same"), (2, "http://x/é", None), (5, "u", ""), (4, "u", "other\r\n\r\nWARC/1.1 é"), (None, "u", "same")]
    got = arc.convert_pages(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, refers_to int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and {d: (r.record_type, r.refers_to) for d, r in by.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 5: ("revisit", 2), 4: ("response", None), None: ("revisit", 1)}
    for d, _, html in rows:
        raw = (html or "").encode()
        assert (by[d].payload_bytes, by[d].payload_digest) == (len(raw), arc.base32_sha1(raw))
    assert arc.convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lengths(version):
    pages = [(1, "http://a/b c", b"x\ny"), (2, None, b""), (3, "u", b"filedesc: 1\n")]
    back = list(arc.read_arc(arc.write_arc(pages, version)))
    assert [arc.http_payload(r.content)[1] for r in back] == [p for _, _, p in pages]
    with pytest.raises(ValueError):
        list(arc.read_arc(arc.write_arc(pages, version)[:-5]))


def test_pii_patterns_and_consistency(spark):
    numbers = "+1 (724) 555-7058"
    rows = [(i, f"call {numbers} now or mail a.b{i}@mail.example.com from 10.0.0.{i}") for i in range(300)]
    rows += [(400, f"first {numbers} then {numbers} 63.51.224"), (401, "plain words without any of it"), (402, None), (403, "4111111111111111 and 4111111111111112")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans int")).collect()}
    for d, t in rows:
        base = pii.base_spans(t or "")
        assert got[d].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(got[d].spans.split(","))
    assert got[401].spans == got[402].spans == "" and got[403].n_card == 1 and got[7].n_email == got[7].n_ip == got[7].n_phone == 1
    # The pattern swallows the digits behind the second number and drops the match; its like in the text brings it back.
    assert "phone:29:" in got[400].spans and got[400].n_phone == 1


def test_pii_odd(odd, empty):
    out = pii.redact_pii(odd).collect()
    assert len(out) == odd.count() and any("[EMAIL] [IP]" in (r.text or "") for r in out)
    assert pii.redact_pii(empty).count() == 0 and pii.find_pii(empty).count() == 0


def test_licenses(spark, odd, empty):
    rows = [(1, "x y. Released under the MIT License. mit\nlicense"), (2, "Licensed under CC BY-NC 4.0."), (3, "license mit public general"), (4, None), (5, "the GNU General Public License, version 3"), (6, "mit license")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(d, t, "?") for d, t in rows], "doc_id long, text string, labels string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels, got[1].score) == (2, 5, 7, "mit", 1.0)
    assert (got[2].base_labels, got[2].labels) == ("", "cc-by-nc") and (got[3].labels, got[4].labels, got[4].n_words) == ("", "", 0)
    assert got[5].base_labels == "gpl" and got[6].base_labels == "mit" and all(0 <= r.score <= 1 for r in got.values())
    assert scan_licenses(odd).count() == odd.count() and scan_licenses(empty).count() == 0


def test_mix_counts(spark):
    size = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total, taken = defaultdict(int), defaultdict(int)
    for s, n in size.values():
        total[s] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    target, left, budget = {}, set(total), sum(total.values())
    while True:
        rest = budget - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * total[s]]
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= set(over)
    target |= share
    first = queries.op8_source_mix(spark, SF).collect()
    for r in first:
        s, n = size[r.doc_id]
        assert (r.size, r.source_size) == (n, total[s]) and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.taken <= 3 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= 0.03 * t + 64 for s, t in target.items())
    assert sorted(first) == sorted(queries.op8_source_mix(spark, SF).collect())


def test_permutation_of_any_size(spark):
    for n in (1, 2, 7, 100, 1000):
        got = sorted(r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5).cast("long"))).collect())
        assert got == list(range(n))


def test_mix_odd(odd, empty):
    rows = mixing.mix_counts(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_blocks(empty).count() == 0
    blocks = mixing.mix_blocks(odd, block_words=100).collect()
    assert blocks and all(len(b.text.split(" ")) <= 100 for b in blocks) and len({b.doc_id for b in blocks}) == len(blocks)


def test_bpe_like_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tokenizer, own, rnd = Tokenizer.from_file(path), bpe.loaded(path), random.Random(8)
    cases = [r.text or "" for r in odd.collect()] + ["".join(rnd.choice(["a", "the", " ", "I'll", "É", "ΑΣ", "!", "7", "　", "\x1c", "日", "é", "<|startoftext|>", "<|", "\n", "🎉"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    ids, n = own.encode(strings(pa.array(cases)))
    ends = np.cumsum(n)
    for t, s, e in zip(cases, ends - n, ends, strict=True):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert want == ids[s:e].tolist(), t
        assert tokenizer.decode(want, skip_special_tokens=False) == own.decode(ids[s:e])


def test_bpe_odd(odd, empty):
    path = queries.tokenizer_file("word_bpe_49k.json")
    assert bpe.digest_documents(odd, path).count() == odd.count() and bpe.digest_documents(empty, path).count() == 0
    assert {len(r.ids) for r in bpe.encode_documents(odd.filter("doc_id < 4"), path).collect()} == {0}


def test_fingerprints(spark):
    docs = sorted(texts(spark).items())
    got = {r.doc_id: r for r in queries.op10_improbable_features(spark, SF).collect()}
    for i, (d, t) in enumerate(docs):
        after, half = docs[(i + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.3 > np.mean([r.near_next for r in long])


def test_entropy_levels():
    data = np.random.default_rng(9).integers(97, 103, 500).astype(np.uint8)
    for i, level in enumerate(digest.levels(data)):
        c = np.bincount(data[i : i + 64])
        p = c[c > 0] / 64
        assert abs(level - -(p * np.log2(p)).sum() / 6 * (digest.LEVELS - 1)) <= 1


def test_fingerprints_odd(odd, empty):
    rows = digest.fingerprints(odd).collect()
    assert len(rows) == odd.count() and len({r.fingerprint for r in rows if r.doc_id == 7}) == 1
    assert digest.fingerprints(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), name, keep=True)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert corpus_pipeline.run(spark, SF).filter("n_tokens > 0").count() > 0


def test_warc_page_with_two_payloads(spark):
    rows = [(1, "u1", "same"), (3, "u3", "same"), (3, "u3", "different"), (4, "u4", "different"), (None, "n", "same"), (None, "n", "own"), (5, "u5", "x" * 3_000_000)]
    got = sorted([(str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in arc.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()], key=str)
    assert got == sorted([("1", 4, "response", None), ("3", 4, "revisit", 1), ("3", 9, "response", None), ("4", 9, "revisit", 3), ("None", 4, "revisit", 1), ("None", 3, "response", None), ("5", 3_000_000, "response", None)], key=str)
    made = arc.write_warc(next(arc.read_arc(arc.write_arc([(3, "u3", b"same")], 1))), 1, "u1").decode()
    assert f"WARC-Refers-To: {arc.record_id('u1', 1)}\r\n" in made


def test_plain_texts_are_alike_only_if_equal(spark):
    rows = [(1, "a" * 500), (2, "b" * 500), (3, None), (4, "b" * 500), (5, "b" * 500)]
    got = {r.doc_id: r for r in digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d].near_next for d in (1, 2, 3, 4)] == [0, 0, 0, 1] and got[2].fingerprint == got[4].fingerprint != got[1].fingerprint
