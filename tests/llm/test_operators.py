"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import os
import random
import struct
import time
import zlib

import numpy as np
import pytest

from fieldglass.llm import brown_lm, common, decontaminate, html_text, media, near_dup, packing, quality, sharding, toxicity, warc

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, label string, key long, _key string, _id long, _rows string, _its_key binary"


def prose(rng, n):
    return " ".join(rng.choice("the of and to in a is that for it") if rng.random() < 0.4 else "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 6, 40, 90, 200])) for _ in range(120)]
    near = prose(rng, 80).split()
    texts += [" ".join(near[:k] + ["changed"] + near[k:]) for k in (5, 30, 60)] + [" ".join(near)] * 3
    texts += [None, "", " \n\t ", "one", "ONE", "one two three four", prose(rng, 20_000), "é ü 漢字 !!", "x" * 5000]
    out = [(i, t, "en", "s", 0, 0.5, "n", "l", 1, "k", 2, "r", b"i") for i, t in enumerate(texts)]
    return out + [out[7], out[7], (None, texts[8], *[None] * 11), (None,) * 13]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def words(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


# 1


def test_shards_follow_the_permutation(docs, empty):
    found = [r.asDict() for r in sharding.sharded(docs, 16).collect()]
    n = len(rows())
    assert sorted(r["row_number"] for r in found) == list(range(n))
    by = collections.defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert sharding.sharded(empty).count() == 0
    assert sorted(map(tuple, sharding.sharded(docs.repartition(5)).collect()), key=str) == sorted((tuple(r.values()) for r in found), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 1025])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted("id", n)).collect()]
    assert sorted(got) == list(range(n))
    xxhash = pytest.importorskip("xxhash")
    a, b = sharding.halves(n)

    def digest(*xs):
        h = 42
        for x in xs:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return h - (1 << 64) if h >> 63 else h

    def walk(p):
        while True:
            left, right = p % a, p // a
            for j in range(1, sharding.ROUNDS + 1):
                if j % 2:
                    left = (left + digest(right, j, sharding.SEED) % a) % a
                else:
                    right = (right + digest(left, j, sharding.SEED) % b) % b
            p = right * a + left
            if p < n:
                return p

    assert got == [walk(i) for i in range(n)]


# 2 and 9


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(3)
    out, marks = [], []
    for i in range(900):
        text = prose(rng, rng.randint(20, 80))
        junk, toxic = i % 6 == 0, i % 5 == 0
        if junk:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        if toxic:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(["vile", "Wretch,", "rotten", "scoundrel"]))
            text = " ".join(parts)
        out.append((i, text, "en", "s", 0, 0.5, "n", "l", 1, "k", 2, "r", b"i"))
        if i % 7:
            marks.append((i, int(not junk), int(toxic)))
    marks += [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(out, KIND), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), out


def test_quality_on_held_out_rows(judged, docs, empty):
    d, labels, out = judged
    found = {r["doc_id"]: r for r in quality.quality_scores(d, labels).collect()}
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i, r in found.items() if r["held_out"]]
    assert np.mean([found[i]["predicted"] == (i % 6 != 0) for i in held]) > 0.98
    assert {r["doc_id"] for r in quality.good_only(d, labels).collect()} == {i for i, r in found.items() if r["predicted"]}
    assert quality.quality_scores(docs, labels).count() == len(rows())
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_statistics_equal_brute_force():
    texts = [r[1] for r in rows() if r[1] is None or len(r[1]) < 20_000] + ["A| B! b! 12 3.", "x  x x\ty\n\ny", "|||", "a, (b) 'c' é", "é漢", "\u00a0 z"]
    want = []
    for text in texts:
        b = (text or "").encode()
        w = b.split()  # b.split splits at the same six bytes
        low = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in w]
        some, chars = max(len(w), 1), max(len(b), 1)
        lengths = np.array([len(x) for x in w] or [0], float)
        upper, other = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 or c >= 128 for c in b)
        mark = lambda c: 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:?'\")"
        share = lambda x, of: math.asin(math.sqrt(min(1, x / of)))
        mean = lengths.sum() / some
        spread = math.sqrt(max((lengths**2).sum() / some - mean**2, 0))
        want.append([
            math.log1p(len(w)), math.log1p(mean), math.log1p(spread), share(upper, max(upper + other, 1)), share(sum(mark(x[-1]) for x in w), some), share(sum(x == y for x, y in zip(low, low[1:], strict=False)), some),
            math.log1p(len(w)) - math.log1p(len({*low})), share(b.count(b"|"), some), share(b.count(b"!"), some), share(sum(48 <= c <= 57 for c in b), chars), share(sum(c in (9, 10, 11, 12, 13, 32) for c in b), chars),
            share(sum(c >= 128 for c in b), chars), share(sum(chr(c) in ".,;:?" for c in b), some), share(b.count(b"\n"), some),
        ])
    assert np.allclose(quality.statistics(quality.pa.array(texts, quality.pa.string())), want, atol=1e-7)


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(size=(200, 4)) * [1, 2, 1, 3], 1: rng.normal(size=(300, 4)) + 2}
    model = quality.fitted({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, 0.0, 0.0)
    point = rng.normal(size=(5, 4))
    log = []
    for k in (0, 1):
        m, s = x[k].mean(0), np.cov(x[k].T, bias=True)
        log.append([math.log(len(x[k]) / 500) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (p - m) @ np.linalg.solve(s, p - m) for p in point])
    assert np.allclose(model.score(point), 1 / (1 + np.exp(np.array(log[0]) - np.array(log[1]))), atol=1e-6)


def test_toxicity_on_held_out_rows(judged, docs, empty):
    d, labels, out = judged
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(d, labels).collect()}
    held = [i for i, r in found.items() if r["held_out"]]
    assert np.mean([found[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    r = found[10]
    data = out[10][1].encode()
    cut = [data[p["first_byte"] : p["end_byte"]].decode().lower() for p in r["passages"]]
    assert cut and any(w in cut[0] for w in ("vile", "wretch", "rotten", "scoundrel"))
    assert {x["doc_id"] for x in toxicity.clean_only(d, labels).collect()} == {i for i, x in found.items() if not x["predicted"]}
    assert toxicity.toxicity_scores(docs, labels).count() == len(rows())
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {x["score"] for x in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(500):
        x = [rng.choice([rng.uniform(-2, 0), rng.uniform(0.1, 3)]) for _ in range(rng.randint(0, 20))]

        def split(lo, hi, x=x):
            best = max(((sum(x[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
            return split(lo, best[1]) + [best] + split(best[2], hi) if best[0] > 1e-12 else []

        want = [(round(s, 6), i, j - 1) for s, i, j in split(0, len(x))]
        assert want == [(round(s, 6), i, j) for s, i, j in toxicity.segments(np.array(x))]


@pytest.mark.parametrize("loss", [0.01, 0.5, 3.0])
def test_segments_take_linear_time(loss):
    rng = np.random.default_rng(1)
    took = []
    for n in (20_000, 200_000):
        x = np.where(rng.random(n) < 0.5, rng.uniform(0, 3, n), -loss)
        x[: n // 2] -= np.linspace(0, 3, n // 2)  # falling sums: many candidates
        began = time.perf_counter()
        toxicity.segments(x)
        took.append(time.perf_counter() - began)
    assert took[0] < 0.2 and took[1] < 40 * took[0] + 0.2


def test_extreme_value_law_is_found_again():
    rng = np.random.default_rng(5)
    k, decay, n = 0.02, 0.7, rng.integers(20, 400, 50_000).astype(float)
    best = np.maximum(0, (np.log(k * n) - np.log(-np.log(rng.random(50_000)))) / decay)
    found = toxicity.extreme_value(best, n, np.ones(50_000))
    assert abs(found[0] / k - 1) < 0.1 and abs(found[1] / decay - 1) < 0.05
    assert toxicity.extreme_value(np.zeros(4), np.ones(4), np.ones(4))[1] == 1


def test_stems_end_between_letters():
    h = toxicity.forms(toxicity.pa.array(["größer größen über überall abcd abcde"]))[0]
    assert h[1, 0] == h[1, 1] != 0 and h[1, 2] == 0 and h[1, 3] != 0 and h[1, 4] == 0 and h[1, 5] != 0
    stem = toxicity.forms(toxicity.pa.array(["größ größXY"]))[0]
    assert stem[1, 0] == 0 and stem[1, 1] == h[1, 0]


def test_word_odds_equal_brute_force(judged):
    d, labels, out = judged
    y = {r["doc_id"]: r["y"] for r in quality.one_label(labels, "toxic").collect()}
    found = toxicity.word_list(d, quality.one_label(labels, "toxic"))
    counts = collections.defaultdict(lambda: [0, 0, 0, 0])
    for i, text, *_ in out:
        if i in y:
            h = toxicity.forms(toxicity.pa.array([text]))[0]
            for x, k in zip(*np.unique(h[h != 0], return_counts=True), strict=True):
                counts[int(x)][1 - y[i]] += int(k)
                counts[int(x)][3 - y[i]] += 1
    nt, nc, dt, dc = (sum(c[k] for c in counts.values()) for k in range(4))
    share, tried = dt / (dt + dc), [c for c in counts.values() if c[2] + c[3] >= toxicity.LEAST_DOCS]
    value = dict(zip(found.word.tolist(), found.value.tolist(), strict=True))
    for x, (t, c, a, b) in counts.items():
        prior = (t + c) * toxicity.PRIOR / (nt + nc)
        odds = math.log((t + prior) / (nt + toxicity.PRIOR - t - prior)) - math.log((c + prior) / (nc + toxicity.PRIOR - c - prior))
        ratio = sum(k * math.log(k / ((a + b) * p)) for k, p in ((a, share), (b, 1 - share)) if k)
        telling = a + b >= toxicity.LEAST_DOCS and ratio >= math.log(len(tried)) + toxicity.MARGIN and (a > (a + b) * share) == (odds > 0)
        assert telling or x not in value
        if telling and odds <= 0:
            assert x in value
        if x in value:
            assert abs(value[x] - odds) < 1e-9
    toxic = toxicity.forms(toxicity.pa.array(["vile wretch rotten scoundrel"]))[0][0]
    assert all(value.get(int(x), 0) > 1 for x in toxic)
    with_words = [counts[x] for x in value]
    assert abs(found.loss - max(1e-3, math.log((1 - sum(c[1] for c in with_words) / nc) / (1 - sum(c[0] for c in with_words) / nt)))) < 1e-9


# 3


def test_media_round_trip(docs, empty):
    found = collections.Counter(tuple(r.asDict()[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in media.media_features(media.media_table(docs)).collect())
    want = collections.Counter()
    for r in rows():
        b = (r[1] or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want[r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert found == want and media.media_table(empty).count() == 0


def test_sniffing_confirms_structure():
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", bytes(13)), (b"IEND", b"")))
    gz = zlib.compressobj(wbits=31)
    gz = gz.compress(b"some data") + gz.flush()
    inner = media.wav(bytes(64))
    for blob, kind in ((png, "image/png"), (gz, "application/gzip"), (inner, "audio/wav")):
        assert media.sniffed(blob) == (kind, [])
        assert media.sniffed(b"text " + blob + b" more") == (None, [(kind, 5, len(blob))])
        assert media.sniffed(blob[:-1]) == (None, [])
    assert media.sniffed(b"RIFF GIF89a BM %PDF-1.4 PK\x03\x04 " * 50) == (None, [])
    whole = media.wav((b"abc" + png).ljust(128, b"\0"))
    assert media.sniffed(whole) == ("audio/wav", [("image/png", 44 + 3, len(png))]) and media.samples(whole) == (b"abc" + png).ljust(128, b"\0")


# 4


def test_packing_places_every_id_once(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    found = [r.asDict() for r in packing.packed(docs, with_ids=True).collect()]
    want = collections.Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows())
    got: dict = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in found:
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        got[r["doc_id"], r["doc_tokens"]][r["start"]].append(tuple(r["ids"]))
    for (doc, ids), n in want.items():
        at = 0
        for start in sorted(got[doc, len(ids)]):
            parts = got[doc, len(ids)][start]
            if start == at and parts.count(ids[at : at + len(parts[0])]) >= n:
                at += len(parts[0])
        assert at == len(ids)
    assert sum(r["length"] for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.packed(empty).count() == 0


def test_added_tokens_are_matched_in_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    texts = [f"a{e}b", f"{e}a b", f"a b{e}", e, e + e + e, f"a  {e}  b{e}\n\n{e} c", f"it's{e}'s", "<|endoftext|", f"<|{e}|>", "<|END|>", f"é{e}漢字" * 300]
    found = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    for i, text in enumerate(texts):
        parts = sorted((r["start"], r["ids"]) for r in found if r["doc_id"] == i)
        assert [x for _, p in parts for x in p] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 511, 512, 700, 1023, 2047, 2048, 2049, 9999])
@pytest.mark.parametrize("capacity", [512, 1000, packing.CAPACITY])
def test_cuts_add_up(n, capacity):
    parts = packing.cuts(n, capacity)
    assert sum(parts) == n and all(0 < p <= capacity for p in parts)


def test_packing_into_shorter_sequences(docs):
    found = packing.packed(docs, capacity=512).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        assert [o for o, _ in sorted(v)] == list(np.cumsum([0, *(n for _, n in sorted(v))])[:-1]) and sum(n for _, n in v) <= 512
    assert sum(r["length"] for r in found) == sum(r["length"] for r in packing.packed(docs).collect())


# 5


def brute_components(table):
    sets = []
    for r in table:
        w = words(r[1])
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(table)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(table)):
        groups[root(i)].append(i)
    out = collections.Counter()
    for g in groups.values():
        ids = [table[i][0] for i in g if table[i][0] is not None]
        for i in g:
            own = min(ids, default=None)
            out[table[i][0], len(sets[i]), own, own is None or table[i][0] == own] += 1
    return out


def test_near_duplicates_equal_brute_force(docs, empty):
    found = near_dup.near_duplicates(docs).collect()
    assert collections.Counter(tuple(r)[:4] for r in found) == brute_components(rows())
    kept = [r["doc_id"] for r in near_dup.one_of_each(docs).collect()]
    table = [r for r in rows() if words(r[1])]
    assert len([k for k in kept]) == len({c[2] for c in brute_components(table)}) + sum(not words(r[1]) for r in rows())
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.one_of_each(empty).count() == 0
    assert near_dup.one_of_each(docs).columns == docs.columns and {r["_key"] for r in near_dup.one_of_each(docs).collect()} == {"k", None}


def test_a_family_of_variants(spark):
    rng = random.Random(11)
    base = prose(rng, 60).split()
    table = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(["aa", "bb", "cc", "dd"])
        table.append((i, " ".join(w)))
    got = collections.Counter(tuple(r)[:4] for r in near_dup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert got == brute_components(table)


def test_links_in_a_large_family(spark):
    # 8,000 texts of similarity 0.6, each with one mate of similarity 0.77: runs of equal beginnings are several windows long
    base = [f"b{k}" for k in range(79)]
    tails = [[f"t{i // 2}x{k}" for k in range(12)] + [f"u{i}x{k}" for k in range(13)] for i in range(8000)]
    table = [(i, " ".join(base + t)) for i, t in enumerate(tails)]
    assert brute_components(table[:60]) == collections.Counter((i, 100, i - i % 2, i % 2 == 0) for i in range(60))
    got = collections.Counter(tuple(r)[:4] for r in near_dup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(8)).collect())
    assert got == collections.Counter((i, 100, i - i % 2, i % 2 == 0) for i in range(8000))


@pytest.mark.parametrize("major", [0, 2000])
def test_shingles_find_links_that_no_window_meets(spark, major):
    # 3,000 texts with a mate each; `major` of them have one label, so only pairs with another are left
    base = [f"b{k}" for k in range(79)]
    tails = [[f"t{i % 1500}x{k}" for k in range(12)] + [f"u{i}x{k}" for k in range(13)] for i in range(3000)]
    text = [" ".join(base + t) for t in tails]
    node = [hashlib.md5(t.encode()).digest() for t in text]
    label = [node[0] if i < major else node[i] for i in range(3000)]
    made = spark.createDataFrame(list(zip(node, label, [b"m" * near_dup.VALUES] * 3000, text, strict=True)), "node binary, label binary, marks binary, text string").repartition(8)
    got = {(bytes(r["a"]), bytes(r["b"])) for r in near_dup._by_shingles(made.drop("text"), made.select("node", "text")).collect()}
    want = {(min(node[i], node[i + 1500]), max(node[i], node[i + 1500])) for i in range(1500) if label[i] != label[i + 1500]}
    # at most the pairs that share a place where both could still be similar enough
    assert want <= got and len(got) < 3 * 1500


def test_shingle_join_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(21)
    text, label = [], []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 30, 60]))]
        for _ in range(25):
            w = list(base[: rng.randint(max(3, len(base) - 12), len(base))])
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
            text.append(" ".join(w))
    text = sorted(set(text))
    sets = near_dup.shingle_sets(near_dup.pa.array(text))
    node = [hashlib.md5(s.tobytes()).digest() for s in sets]
    label = [node[i % 40] if i % 3 else node[i] for i in range(len(text))]
    made = spark.createDataFrame(list(zip(node, label, [b"m" * near_dup.VALUES] * len(text), text, strict=True)), "node binary, label binary, marks binary, text string")
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    got = {(bytes(r["a"]), bytes(r["b"])) for r in near_dup._by_shingles(made.drop("text"), made.select("node", "text")).collect()}
    want = set()
    for i in range(len(text)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if label[i] != label[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                want.add((min(node[i], node[j]), max(node[i], node[j])))
    assert len(want) > 100 and want <= got


@pytest.mark.parametrize(("parts", "few"), [(1, common.FEW_KEYS), (8, common.FEW_KEYS), (64, common.FEW_KEYS), (8, 0)])
def test_a_dense_family_under_any_partitioning(spark, monkeypatch, parts, few):
    monkeypatch.setattr(common, "FEW_KEYS", few)  # with 0 the dense runs are found by shuffle
    rng = random.Random(31)
    base = prose(rng, 70).split()
    table = []
    for i in range(2200):
        w = list(base)
        for _ in range(rng.randint(3, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        table.append((i, " ".join(w)))
    want = test_a_dense_family_under_any_partitioning.__dict__.setdefault("want", {})
    if not want:
        want.update(brute_components(table))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = collections.Counter(tuple(r)[:4] for r in near_dup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(parts)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == collections.Counter(want)


# 6


def test_archive_round_trip(spark):
    big, small = "<p>" + "é" * 100 + "</p>", "<p>x</p>"
    table = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "z" * 200), (7, "u", "z" * 200)]
    pages = spark.createDataFrame([(*r, "t") for r in table], "page_id long, url string, html string, digest string")
    path = warc.write_archive(pages)
    found = collections.Counter(tuple(r) for r in warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = collections.Counter()
    for i, _, h in table:
        b = (h or "").encode()
        ids = [k for k, _, x in table if (x or "").encode() == b and k is not None]
        again = len(b) >= 100 and i != min(ids)
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(ids) if again else None] += 1
    assert found == want
    byte = collections.Counter((i, (h or "").encode()) for i, _, h in table)
    seen = collections.Counter()
    for r in warc.rebuilt(spark, path).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields[b"WARC-Type"].decode() == r["record_type"]
        length = int(fields[b"Content-Length"])
        assert block[length:] == b"\r\n\r\n"
        if r["record_type"] == "response":
            http, _, payload = block[:length].partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in http and fields[b"Content-Type"].startswith(b"application/http")
            assert fields[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(payload).hexdigest().encode() and byte[r["page_id"], payload]
            if r["page_id"] == 1:
                assert fields[b"WARC-Target-URI"] == b"http://a/%0D%0Ax"
        else:
            assert length == 0
        seen[r["page_id"]] += 1
    assert seen == collections.Counter(i for i, _, _ in table)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    assert warc.archived(pages.limit(0)).count() == 0


# 7


@pytest.mark.parametrize(("local_min", "least"), [(2, 3), (1, 1), (10**9, 10**9)])
def test_lm_scores_equal_brute_force(docs, empty, monkeypatch, local_min, least):
    monkeypatch.setattr(brown_lm, "LOCAL_MIN", local_min)  # so that some words, or all, are joined
    monkeypatch.setattr(brown_lm, "MIN", least)
    models = []
    train = brown_lm.trained
    monkeypatch.setattr(brown_lm, "trained", lambda d: models.append(train(d)) or models[-1])
    found = brown_lm.scored(docs).collect()
    tokens = [words(r[1]) + [None] for r in rows()]
    counts = collections.Counter()
    for r, w in zip(rows(), tokens, strict=True):
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    m = models[0][0]
    # class of each word, from its unit
    h, tails, _ = brown_lm.read(brown_lm.pa.array([b" ".join(x for x in counts if x is not None).decode()]))
    unit = dict(zip([x for x in counts if x is not None] + [None], m.vocab.find(h, tails)[0].tolist(), strict=True))
    assert unit[None] == m.vocab.size - 1 and m.of[unit[None]] == 0 and list(m.of).count(0) == 1
    of = {w: int(m.of[u]) for w, u in unit.items()}
    tallies = collections.Counter()
    for w, k in counts.items():
        tallies[of[w]] += k
    sizes = collections.Counter(of.values())
    bigrams = collections.Counter()
    for r, w in zip(rows(), tokens, strict=True):
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            bigrams.update((of[x], of[y]) for x, y in zip([None] + w, w, strict=False))
    after = collections.Counter()
    for (x, _), k in bigrams.items():
        after[x] += k

    def class_of(word):
        if word in of:
            return of[word]
        h, tails, _ = brown_lm.read(brown_lm.pa.array([word.decode()]))
        return int(m.of[m.vocab.find(h, tails)[0][0]])

    def p(x, y, word):
        step = (bigrams[x, y] + brown_lm.SMOOTH) / (after[x] + brown_lm.SMOOTH * brown_lm.CLASSES)
        return step * (counts[word] + 1) / (tallies[y] + sizes[y] + 1)

    want = collections.Counter()
    for r, w in zip(rows(), tokens, strict=True):
        c = [0] + [class_of(x) for x in w]
        score = sum(math.log10(p(x, y, word)) for x, y, word in zip(c, c[1:], w, strict=False))
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[r[0], len(w), sum(counts[x] > 0 for x in w), n, f"{base:.7g}", f"{score:.7g}"] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.7g}", f"{r['score']:.7g}") for r in found) == want
    for x in range(brown_lm.CLASSES):  # all known words and one unknown word a class share all of the probability
        assert abs(sum(p(x, of[w], w) for w in counts) + sum((bigrams[x, y] + 0.1) / (after[x] + 0.1 * brown_lm.CLASSES) / (tallies[y] + sizes[y] + 1) for y in range(brown_lm.CLASSES)) - 1) < 1e-9
    if least == 3:
        assert brown_lm.scored(empty).count() == 0


def test_gain_of_a_move_equals_the_difference_of_likelihoods():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 6, (9, 9)) * rng.integers(0, 2, (9, 9)).astype(float)
    of = rng.integers(0, 4, 9)
    table = lambda of: np.eye(4)[of].T @ pairs @ np.eye(4)[of]
    member = np.eye(4)[of]
    found = brown_lm.gains(table(of), pairs.T @ member, pairs @ member, np.diag(pairs), of)
    for w in range(9):
        moved = [brown_lm.likelihood(table(np.where(np.arange(9) == w, k, of))) for k in range(4)]
        assert np.allclose(np.array(moved) - moved[of[w]], found[w] - found[w, of[w]], atol=1e-9)


def test_rounds_in_spark_raise_the_likelihood(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "MIN", 2)
    monkeypatch.setattr(brown_lm, "SEQUENTIAL", brown_lm.ENDINGS + 21)
    rng = random.Random(9)
    kinds = [[f"{c}{k}" for k in range(60)] for c in "pqr"]
    texts = [" ".join(rng.choice(kinds[k % 3]) for k in range(rng.randint(1, 120))) for _ in range(150)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    counts = train.mapInArrow(brown_lm._counts, "word long, tail int, n long").groupBy("word").agg(brown_lm.F.first("tail").alias("tail"), brown_lm.F.sum("n").alias("n"))
    vocab = brown_lm.vocabulary(counts)
    pairs = brown_lm.bigrams(train, vocab)
    got = collections.Counter()
    for r in pairs.collect():
        code, n = brown_lm._decoded(r["pairs"], r["size"])
        assert len(np.unique(code)) == len(code)
        for c, k in zip(code.tolist(), n.tolist(), strict=True):
            x, y = c >> brown_lm.SHIFT + 1, c & ((1 << brown_lm.SHIFT) - 1)
            got[(x, y, 0) if not c >> brown_lm.SHIFT & 1 else (y, x, 1)] += k
    want = collections.Counter()
    for t in texts:
        h, tails, _ = brown_lm.read(brown_lm.pa.array([t]))
        u = [vocab.size - 1, *vocab.find(h, tails)[0].tolist()]
        want.update((x, y, k) for x, y in zip(u, u[1:], strict=False) for k in (0, 1))
    assert got == want
    monkeypatch.setattr(brown_lm, "ROUNDS", 0)
    _, first, _ = brown_lm.clustered(pairs, vocab, np.zeros(vocab.own, np.int64))
    monkeypatch.setattr(brown_lm, "ROUNDS", 6)
    of, table, log = brown_lm.clustered(pairs, vocab, np.zeros(vocab.own, np.int64))
    assert log[0] == brown_lm.likelihood(first) and log[-1] == brown_lm.likelihood(table) and len(log) > 1
    assert all(x < y for x, y in zip(log, log[1:], strict=False))
    assert np.array_equal(table, brown_lm.class_table(pairs, of)) and table.sum() == sum(map(len, map(str.split, texts))) + len(texts)


def test_blocks_are_added_up_and_cut_between_words(monkeypatch):
    monkeypatch.setattr(brown_lm, "ROW_PAIRS", 100)
    rng = np.random.default_rng(2)
    rows_, want = [], collections.Counter()
    for block in (0, 0, 0, 0, 0, 0, 3, 3, 7):
        code = np.unique((rng.integers(0, 40, 150) * 8 + block) << brown_lm.SHIFT + 1 | rng.integers(0, 60, 150))
        n = rng.integers(1, 5, len(code))
        want.update(dict(zip(code.tolist(), n.tolist(), strict=True)))
        rows_.append((block, *brown_lm._coded(code, n)))
    batches = [brown_lm.pa.RecordBatch.from_arrays([brown_lm.pa.array(c) for c in zip(*part, strict=True)], ["block", "pairs", "size"]) for part in (rows_[:2], rows_[2:7], rows_[7:])]
    got, owner = collections.Counter(), {}
    out = [r for b in brown_lm._merged(iter(batches)) for r in b.to_pylist()]
    for k, r in enumerate(out):
        code, n = brown_lm._decoded(r["pairs"], r["size"])
        assert r["size"] < 300 and all(owner.setdefault(c >> brown_lm.SHIFT + 1, k) == k for c in code.tolist())
        got.update(dict(zip(code.tolist(), n.tolist(), strict=True)))
    assert got == want and len(out) > 5


def test_exchange_finds_the_two_kinds_of_words():
    pairs = np.zeros((8, 8))
    for i in range(8):
        for j in range(8):
            pairs[i, j] = 50 + i + j if (i < 4) == (j < 4) else 1
    of = brown_lm.exchanged(pairs, 2, 10)
    assert len(set(of[:4])) == 1 and len(set(of[4:])) == 1 and of[0] != of[7]


# 8


def test_page_text():
    page = '<html><head><title>t</title></head><body><nav><a>Home</a></nav><header>Site</header><div class="cookie-notice">ok?</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five &eacute;<div class="ad">buy</div><form>x</form><script>var a="</p>";</script><section class="comments"><p>first!</p></section></article><footer>f</footer>'
    assert [t for t, _ in html_text.lines(page)] == ["A & B", "one two three four", "five é"]
    assert html_text.lines("") == []
    assert html_text.shared(list("abcbdab"), list("bdcaba")) and len(html_text.shared(list("abcbdab"), list("bdcaba"))) == 4


def test_differencing_deletes_what_neighbours_share(spark):
    def page(body):
        return f"<div><p>Welcome to us</p><p>{body}</p><p>Read more here</p></div>"

    table = [(1, "http://h/a/1", page("first story")), (2, "http://h/a/2", page("second story")), (3, "http://other/x", page("alone")), (4, None, None), (5, "http://k/1", "<article><p>same</p></article>"), (6, "http://k/2", "<article><p>same</p></article>")]
    found = {r["page_id"]: r for r in html_text.main_texts(spark.createDataFrame([(*r, "t") for r in table], "page_id long, url string, html string, text string").coalesce(1)).collect()}
    assert found[1]["text"] == "first story" and found[2]["text"] == "second story" and found[4]["text"] == ""
    assert found[3]["text"] == "Welcome to us\nalone\nRead more here" and found[5]["text"] == found[6]["text"] == "same"
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1, 30, 1 << 28])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(html_text, "CELLS", cells)  # so that long ones are halved
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg"[: rng.randint(1, 7)]) for _ in range(rng.randint(0, 25))] for _ in range(2))
        places = sorted(html_text.shared(a, b))
        rest = iter(b)
        assert len(places) == brute_lcs(a, b) and all(a[i] in rest for i in places)


def test_shared_lines_of_long_pages():
    rng = random.Random(7)
    assert len(html_text.shared(["Reply"] * 2500, ["Reply"] * 2500)) == 2500
    a = [f"line {i}" for i in range(20_000)]
    assert html_text.shared(a, a[::2]) == set(range(0, 20_000, 2))
    a = [rng.choice(["Reply", "Share", "Like"]) for _ in range(30_000)]
    assert len(html_text.shared(["x", *a], [*a[1:], "y"])) == 29_999


@pytest.mark.parametrize("parts", [1, 7])
def test_differencing_equals_brute_force(spark, parts):
    rng = random.Random(12)
    table = []
    for i in range(60):
        host = rng.choice(["a.org", "b.org", "c.org"]) if i != 59 else "lonely.org"
        top, bottom = ([f"{host} {w} {k}" for k in range(rng.choice([2, 3]))] for w in ("menu", "end"))
        body = [f"story {i} {k}" for k in range(rng.choice([0, 2, 4]))] if i != 17 else [f"long {k}" for k in range(3000)]
        parts_ = top + body + (["Share"] * rng.randint(0, 3)) + bottom
        table.append((i, f"https://{host}/{rng.choice(['x', 'x/y', 'z'])}/{rng.randrange(20)}", "".join(f"<p>{x}</p>" for x in parts_)))
    table += [(100 + k, table[k][1], table[k][2]) for k in (3, 4, 5)] + [(3, table[3][1], table[3][2]), (None, table[6][1], table[6][2]), (110, "https://same.org/1", "<p>q</p>"), (111, "https://same.org/2", "<p>q</p>")]
    plain = [(i, u.split("/")[2], "/" + u.split("/", 3)[3], [t for t, _ in html_text.lines(h)]) for i, u, h in table]
    first = {}
    for k, (i, host, path, own) in sorted(enumerate(plain), key=lambda r: (r[1][2], r[1][0] is not None, r[1][0] or 0, r[0])):
        first.setdefault((host, tuple(own)), (host, path, own))
    order = sorted(first.values(), key=lambda r: (r[0], r[1]))
    want = collections.Counter()
    for (i, host, path, own), (_, url, _) in zip(plain, table, strict=True):
        at = order.index(first[host, tuple(own)])
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order) and order[k][0] == host]
        text = own
        if near:
            path = order[at][1]
            same = lambda n, path=path: sum(len(s) + 1 for s in os.path.commonprefix([n[1].split("/"), path.split("/")]))
            other = max(near, key=same)[2]
            drop = html_text.shared(own, other)
            assert len(drop) == brute_lcs(own, other)
            text = [t for k, t in enumerate(own) if k not in drop]
        want[i, url, "\n".join(text)] += 1
    pages = spark.createDataFrame([(*r, b"t") for r in table], "page_id long, url string, html string, digest binary").repartition(parts)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = collections.Counter((r["page_id"], r["url"], r["text"]) for r in html_text.main_texts(pages).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == want
    assert got[110, "https://same.org/1", "q"] == got[111, "https://same.org/2", "q"] == 1


def test_names_of_missing_things_mark_nothing():
    assert [t for t, _ in html_text.lines('<article><p class="ad-free">kept</p><p class="ad-box">gone</p><p class="lead ad-free">kept too</p></article>')] == ["kept", "kept too"]


def test_implied_ends_and_names_that_mark_no_role():
    def texts(html):
        return [t for t, _ in html_text.lines(html)]

    assert texts('<article><p class="ad">x<p>real text<p>more</article>') == ["real text", "more"]
    assert texts('<article><ul><li class="menu">x<li>y</ul><p>z</p></article>') == ["y", "z"]
    assert texts('<article><ul><li>y<li class="menu">x <b>x</b></ul>z</article>w') == ["y", "z", "w"]
    assert texts('<article><ul><li class="menu"><p>x<ul><li>x<li>x</ul>x<li>y</ul></article>') == ["y"]
    assert texts('<article><table><tr class="ad"><td>x<td>x<tr><td>y<td class="share">x<td>z</table>w</article>') == ["y", "z", "w"]
    assert texts('<article><dl><dt class="ad">x<dd>y<dt>z</dl><div class="ad"><p>x</div><p class="ad">x<div>v</div></article>') == ["y", "z", "v"]
    assert texts('<article><aside><p>x<p>x<li>x</aside><p id="notice-of-death">obituary</p>a <span class="search">quick</span> fox<p id="notice">x</article>') == ["obituary", "a quick fox"]


# 10


def test_leaks_of_exact_and_edited_items(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, None), (7, ""), (8, "zeta kappa")]
    w = items[1][1].split()
    edited = " ".join(["other" if k % 9 == 4 else x for k, x in enumerate(w)])
    table = [(0, prose(rng, 50)), (1, prose(rng, 40) + " " + items[0][1] + " " + prose(rng, 40)), (2, prose(rng, 30) + " " + edited.upper() + "!! " + prose(rng, 30)), (3, items[2][1]), (4, " ".join(items[3][1].split()[:6])), (5, "so zeta, Kappa it is"), (None, items[4][1]), (7, None), (8, "")]
    corpus, bench = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(corpus, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (3, 2), (5, 8), (None, 4)}
    r = found[1, 0]
    assert table[1][1].encode()[r["first_byte"] : r["end_byte"]].decode() == items[0][1] and r["score"] == 1
    assert {r["doc_id"] for r in decontaminate.without_leaks(corpus, bench).collect()} == {0, 4, 7, 8}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.without_leaks(docs, bench).columns == docs.columns


def test_long_passages_count_whatever_the_items_length(spark):
    rng = random.Random(18)
    items = [(i, prose(rng, 300)) for i in range(3)]
    table = [(0, prose(rng, 60) + " " + " ".join(items[0][1].split()[40:160]) + " " + prose(rng, 60)), (1, prose(rng, 30) + " " + " ".join(items[1][1].split()[-30:])), (2, prose(rng, 400))]
    corpus, bench = spark.createDataFrame([(*r, "x", b"y") for r in table], "doc_id long, text string, item string, text_key binary"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(corpus, bench).collect()} == {(0, 0), (1, 1)}
    kept = decontaminate.without_leaks(corpus, bench)
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == corpus.columns


def test_edited_copies_are_found_as_by_alignment_of_all_pairs(spark):
    rng = random.Random(28)
    items = [(i, prose(rng, rng.choice([9, 16, 30, 60]))) for i in range(40)] + [(40, "same words here twice"), (41, "Same words here twice!"), (42, "one"), (43, None)]
    table = []
    for i in range(240):
        w = items[i % 40][1].split()
        every = rng.choice([3, 4, 5, 8, 100])
        w = [x if k % every != every - 1 or rng.random() < 0.2 else rng.choice(["edited", "", "more words", "changed"]) for k, x in enumerate(w)]
        table.append((i, prose(rng, rng.randint(0, 40)) + " " + " ".join(w) + " " + prose(rng, rng.randint(0, 40))))
    table += [(300, "the same words here twice and"), (301, table[0][1]), (302, prose(rng, 3000))]
    corpus, bench = spark.createDataFrame(table, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(corpus, bench).collect()}
    want = set()
    hashed = {i: decontaminate.tokens(decontaminate.pa.array([t or ""]))[0] for i, t in items}
    for i, text in table:
        h = decontaminate.tokens(decontaminate.pa.array([text]))[0]
        for j, own in hashed.items():
            if len(own):
                score, first, last = decontaminate.aligned(own, h)
                equal = np.isin(h[first : last + 1], own).sum()
                if (score >= 2 * len(own) * decontaminate.SHARE and equal >= min(8, len(own))) or score >= 50:
                    want.add((i, j))
    assert len(want) > 150 and found <= want
    assert len(found) >= 0.9 * len(want)
    assert {(300, 40), (300, 41)} <= found and {j for i, j in found if i == 301} == {j for i, j in found if i == 0}


def test_what_many_items_share_is_evidence_of_none(spark):
    rng = random.Random(38)
    prompt, poem = prose(rng, 30), prose(rng, 40)
    items = [(i, prompt + " " + prose(rng, 12 + i % 9)) for i in range(100)] + [(200 + i, poem + " " + w) for i, w in enumerate("one two three four five six seven eight nine ten".split())] + [(300, None), (301, prompt)]
    own = {i: t[len(prompt) + 1 :] for i, t in items[:100]}
    table = [(i, prose(rng, 20) + " " + prompt + " " + prose(rng, 20)) for i in range(120)]
    table += [(1000 + i, prose(rng, 20) + " " + (prompt + " " if i % 2 else "") + own[i] + " " + prose(rng, 20)) for i in range(10)] + [(2000, poem), (2001, prose(rng, 60))]
    corpus, bench = spark.createDataFrame(table, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    found = [(r["doc_id"], r["item_id"], r["items"]) for r in decontaminate.leaks(corpus, bench).collect()]
    # the prompt is an item too: it has nothing of its own and is found once in each text
    assert sorted(x for x in found if x[1] == 301) == [(i, 301, 1) for i in [*range(120), *range(1001, 1010, 2)]]
    rest = sorted(x for x in found if x[1] != 301)
    assert rest[:-1] == [(1000 + i, i, 1) for i in range(10)]
    assert rest[-1][0] == 2000 and 200 <= rest[-1][1] < 210 and rest[-1][2] == 10
    plain = bench.where("item_id < 100")
    assert {r["doc_id"] for r in decontaminate.leaks(corpus, plain).collect()} == {*range(1000, 1010)}
    assert decontaminate.without_leaks(corpus, plain).count() == 122


def test_stretches_between_common_runs(spark):
    words = np.arange(1, 61, dtype=np.uint64)
    rows = [(b"a", words.tobytes(), [0, 1, 2, 20, 40], 7), (b"b", words[:12].tobytes(), [0, 3, 7], 5)]
    kinds = "item binary, words binary, places array<long>, least long"
    got = {bytes(r["item"]): (np.frombuffer(r["words"], np.uint64).tolist(), r["variant"]) for r in spark.createDataFrame(rows, kinds).mapInArrow(decontaminate._own_words, "item binary, words binary, variant long").collect()}
    assert got == {b"a": ([*range(8, 21), *range(26, 41), *range(46, 61)], None), b"b": ([*range(1, 13)], 5)}


def test_alignment_equals_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randint(1, 12))], np.uint64) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.aligned(a, b)[0] == h.max()


def test_items_that_share_only_some_common_runs_are_each_looked_for(spark):
    rng = random.Random(39)
    items, table = [], []
    for k in range(6):
        prompt = prose(rng, 120)
        for side in range(2):
            tail = prose(rng, 40)
            at = 100 * k + 50 * side
            items += [(at + i, f"{prompt} {tail} {w}") for i, w in enumerate("one two three four five six seven eight nine ten".split())]
            table.append((at, prose(rng, 20) + " " + tail + " " + prose(rng, 20)))
    corpus, bench = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"] // 50 * 50, r["items"]) for r in decontaminate.leaks(corpus, bench).collect())
    assert found == [(i, i, 10) for i, _ in table]


def test_whole_copies_of_items_with_own_words_in_short_stretches_are_found(spark):
    rng = random.Random(40)
    shared = [prose(rng, 20) for _ in range(4)]
    own = [[prose(rng, 5) for _ in range(4)] for _ in range(12)]
    items = [(i, " ".join(f"{s} {w}" for s, w in zip(shared, own[i], strict=True))) for i in range(12)]
    table = [(i, prose(rng, 30) + " " + items[i][1] + " " + prose(rng, 30)) for i in range(12)]
    table += [(100 + i, prose(rng, 30) + " " + " ".join(own[i]) + " " + prose(rng, 30)) for i in range(12)]  # without what all share
    table += [(200, prose(rng, 30) + " " + " ".join(shared) + " " + prose(rng, 30)), (201, " ".join(s + " " + prose(rng, 5) for s in shared))]  # nothing else
    corpus, bench = spark.createDataFrame(table, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["score"], r["items"]) for r in decontaminate.leaks(corpus, bench).collect())
    assert found == [(i, i, 1.0, 1) for i in range(12)] + [(100 + i, i, 1.0, 1) for i in range(12)]
    assert {r["doc_id"] for r in decontaminate.without_leaks(corpus, bench).collect()} == {200, 201}
