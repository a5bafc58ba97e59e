"""Each operator against brute force, and its defined results on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lattiq.llm import components as cc
from lattiq.llm import embed_dedup, langid, media, mixing, quality, sentencepiece_codec, sharding, simhash, suffix_dedup, token_store
from lattiq.llm.common import Workspace, split_hot, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "".join(f"word{i} of a very long text, " for i in range(4000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, "12 34 ***", "en", "a", 9),
    (4, "The cat sat on the mat and then the cat sat on the mat again and again and again until the evening came to it.", "en", "a", 5),
    (5, "The cat sat on the mat and then the cat sat on the mat again and again and again until the evening came to it.", "en", None, 5),
    (5, "The cat sat on the mat and then the cat sat on the mat again and again and again until the evening came to it.", "en", None, 5),
    (None, "Le chat est sur la table et la table est dans la maison de la ville où il fait très beau \x00 ▁ 漢字 😀.", "fr", "b", 7),
    (7, LONG, "en", "b", 1),
    (8, " \t\n", "fr", "b", 1),
    (9, "Der Hund und die Katze sind in dem Haus und der Garten ist sehr groß.", "de", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'x' as size", "1 as shard", "2.0 as score", "'k' as key", "0 as rank", "'z' as mark", "1 as position")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


# ----- 1 language ID


def test_language_is_learned_and_odd_texts_are_undetermined(docs, odd, empty):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows(langid.language_of_documents(docs)) if r["held_out"]]
    assert held and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    for r in rows(docs.limit(20)):
        assert (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == next(x["held_out"] for x in rows(langid.language_of_documents(docs).where(f"doc_id = {r['doc_id']}")))
        break
    out = rows(langid.language_of_documents(odd))
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 8)} == dict.fromkeys((1, 2, 3, 8), "und")
    assert rows(langid.language_of_documents(empty)) == []
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in rows(kept)} == {4, 5, 7, 9, None}


def plain_grams(text, bits):
    """Buckets of all 1- to 3-grams, written out: letters in lower case, one space for all else and at both ends."""
    line = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in " " + text.lower() + " "))
    out = []
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            h = 0
            for k, c in enumerate(line[i : i + n]):
                h = (h * 0x100000001B3 + ord(c) + k + 1) % 2**64
            out.append((h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - bits))
    return out


def plain_model(langs, bits=6):
    rng = np.random.default_rng(0)
    table_ = np.vstack([np.log(rng.dirichlet(np.ones(1 << bits), langs)).T, np.zeros(langs)])
    return langid.LanguageModel([chr(97 + k) for k in range(langs)], bits, np.log(np.full(langs, 1 / langs)), table_)


def test_language_scores_equal_a_plain_sum(monkeypatch):
    m = plain_model(3)
    texts = ["Hello, World", "çà et là", "x", "zz " * 50, "", "12", "Ein Satz; " * 40, "漢字 \x00 ÀB"]
    for chars in (1 << 15, 64, 7):  # stretches that cut texts anywhere
        monkeypatch.setattr(langid, "CHUNK", chars)
        lang, score = langid.score_texts(texts, m)
        for t, got, s in zip(texts, lang, score):
            if not any(c.isalpha() for c in t):
                assert (got, s) == ("und", 0)
                continue
            like = m.log_prior + sum(m.log_prob[b] for b in plain_grams(t, 6))
            post = np.exp(like - like.max()) / np.exp(like - like.max()).sum()
            assert got == m.langs[int(post.argmax())] and math.isclose(s, post.max(), rel_tol=1e-9)


def test_a_very_long_text_is_scored_whole_whatever_the_number_of_languages():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh éß,. 0"), 1_000_000))
    counts = np.bincount(plain_grams(text, 6), minlength=65)[:64]
    for langs in (4, 40):
        got = np.zeros((langs, 64))
        m = plain_model(langs)
        total = np.zeros(64, int)
        for _, _, _, found in langid.stretches([text], 6):
            for r in found:
                total += np.bincount(r, minlength=65)[:64]
        assert (total == counts).all()
        like = m.log_prior + counts @ m.log_prob[:64]
        assert langid.score_texts([text], m)[0] == [m.langs[int(like.argmax())]], got.shape


# ----- 2 sharding


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_schedule_is_what_the_heap_gives_group_by_group(shards):
    rng = np.random.default_rng(shards)
    classes = [(int(s), int(c)) for s, c in zip(rng.choice(np.arange(1, 60), 12, replace=False), rng.integers(1, 200, 12))]
    loads, want = [0] * shards, {}
    for size, count in sorted(classes, reverse=True):
        for _ in range(count):
            j = min(range(shards), key=lambda k: (loads[k], k))
            loads[j] += size
            want[size, j] = want.get((size, j), 0) + 1
    got = {(size, j): k for size, parts in sharding.schedule(classes, shards) for j, k in parts}
    assert got == want


def test_shards_hold_groups_and_slots_are_gapless(docs, odd, empty):
    for df in (docs, odd):
        out = rows(sharding.shards_of_documents(df))
        texts = [(r["doc_id"], r["text"] or "") for r in rows(df)]
        assert len(out) == len(texts)
        assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in texts)
        groups = {}
        for r in out:
            groups.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        assert all(len(s) == 1 for s in groups.values())
        for j in range(40):
            slots = sorted(r["slot"] for r in out if r["shard"] == j)
            assert slots == list(range(len(slots)))
    sizes = {}
    for r in rows(sharding.shards_of_documents(docs)):
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert max(sizes.values()) <= max(sum(sizes.values()) / 40 * 1.1, max(len((r["text"] or "").encode()) for r in rows(docs)) * 8)
    assert rows(sharding.shards_of_documents(empty)) == []


# ----- 3 suffix-array dedup


def brute_repeats(texts: list[tuple], window: int = 100):
    seen, out = {}, {}
    for doc, text in texts:
        b = (text or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if seen.setdefault(w, (doc, i)) != (doc, i):
                cover[i] += 1
                cover[min(i + window, len(b))] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdef "), 400))
    texts = [(i, "".join(rng.choice(list("abc "), int(rng.integers(0, 300)))) + (passage[int(rng.integers(0, 100)) : int(rng.integers(150, 400))] if i % 3 else "") + "é" * (i % 4) + "ab" * int(rng.integers(0, 120))) for i in range(40)]
    texts += [(100, "x" * 500), (101, "x" * 99), (102, "x" * 100), (103, "\x00" * 230), (104, "\x00" * 150 + "y"), (105, None), (106, "")]
    small = spark.createDataFrame(texts, "doc_id long, text string")
    for df, source in ((small, texts), (docs, [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.deduplicated_documents(df))}
        assert got == brute_repeats(source)


def test_repeats_on_odd_rows_and_very_long_parts(odd, empty, spark, monkeypatch):
    out = rows(suffix_dedup.deduplicated_documents(odd))
    assert len(out) == len(ODD)
    five = [r for r in out if r["doc_id"] == 5]
    assert len(five) == 2 and five[0] == five[1] and five[0]["n_removed"] == five[0]["n_bytes"]  # document 4 has the text first
    assert next(r for r in out if r["doc_id"] == 4)["n_removed"] == 0
    assert rows(suffix_dedup.deduplicated_documents(empty)) == []
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD) - 2
    texts = [("".join(chr(97 + (i * i + k) % 23) for i in range(3000)), k) for k in (0, 0, 1)]
    b = [t.encode() for t, _ in texts]
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 900)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([7, 7, 8]), pa.array([t for t, _ in texts])], names=["doc_id", "mark", "text"])
    blocks = pa.concat_tables([pa.Table.from_batches([x]) for x in suffix_dedup._blocks([batch], 1)])
    found = suffix_dedup._spans_of_documents(suffix_dedup._spans_of_bucket(blocks, 1)).to_pylist()
    parts = {r["s_id"]: r["spans"] for r in found}
    want = brute_repeats([(k, t) for k, (t, _) in enumerate(texts)])
    for k in range(3):
        kept, removed, runs = suffix_dedup.cut(b[k], parts.get(k))
        assert (len(b[k]), removed, runs, hashlib.sha256(kept).hexdigest()) == want[k]


@pytest.mark.parametrize("hot", [0, 1])
def test_split_minimisers_and_equal_hashes_change_nothing(spark, monkeypatch, hot):
    rng = np.random.default_rng(3)
    line = "This line of words stands in very many texts of the table, in front of and behind others."  # under a window
    texts = []
    for i in range(120):
        around = "".join(rng.choice(list("abcde "), 300))
        texts.append((i, around[:150] + line + (around[150:] if i % 4 else texts[i - 3][1][240:]) if i > 3 else around + line))
    found = []
    real = suffix_dedup.hot_keys
    if hot:
        monkeypatch.setattr(suffix_dedup, "hot_keys", lambda docs: found.append(real(docs, 12)) or found[-1])
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.deduplicated_documents(df))}
    assert got == brute_repeats(texts) and any(r[1] for r in got.values())
    if hot:
        assert len(found[0][0]) and len(found[0][1])  # both levels were split


def test_pieces_of_equal_hash_and_different_bytes_are_apart():
    text = b"x" * 100 + b"x" * 100 + b"y" * 100
    head = suffix_dedup.equal_to_heads(text, np.array([0, 100, 200]), np.full(3, 100), np.zeros(3, np.int64))
    assert head.tolist() == [0, 0, 2]


def test_spans_come_from_the_tree(monkeypatch):
    texts = [(0, "".join(f"{i} " for i in range(100))), (1, "".join(f"{i} " for i in range(100)))]
    seen = []
    real = suffix_dedup.repeats_in_bucket
    packed = [suffix_dedup._blocks([pa.RecordBatch.from_pydict({"doc_id": [k], "mark": [k], "text": [t]})], 1) for k, t in texts]

    table_ = pa.concat_tables([pa.Table.from_batches([x]) for p in packed for x in p])
    monkeypatch.setattr(suffix_dedup, "repeats_in_bucket", lambda *a: seen.append(1) or iter(()))
    assert suffix_dedup._spans_of_bucket(table_, 1).num_rows == 0 and seen
    monkeypatch.setattr(suffix_dedup, "repeats_in_bucket", real)
    (span,) = suffix_dedup._spans_of_documents(suffix_dedup._spans_of_bucket(table_, 1)).to_pylist()
    assert span["s_id"] == 1 and span["spans"] == [0, len(texts[1][1])]


def test_suffix_array_and_maximal_repeats_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        texts = [rng.choice(np.array([97, 98], np.uint8), int(rng.integers(8, 30))).tobytes() for _ in range(4)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        piece = np.repeat(np.arange(4), [len(t) for t in texts])
        at, end = np.arange(len(data)), ends[piece]
        order, common = suffix_dedup.suffix_array(data, np.zeros(len(at), int), at, end)
        suffixes = [bytes(data[at[i] : end[i]]) for i in order]
        assert suffixes == sorted(suffixes)
        for k in range(1, len(order)):
            a, b = suffixes[k - 1], suffixes[k]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert common[k] == n
        before = np.array([data[i - 1] if i and piece[i - 1] == piece[i] else -1 - i for i in at], int)[order]
        got = {(size, tuple(sorted(at[order[a : b + 1]].tolist()))) for a, b, size in suffix_dedup.maximal_repeats(order, common, before, 3)}
        want = {}
        for size in range(3, 30):
            places = {}
            for i in at:
                if i + size <= end[i]:
                    places.setdefault(bytes(data[i : i + size]), []).append(int(i))
            for p in places.values():
                left = {before_of for before_of in (int(data[i - 1]) if i and piece[i - 1] == piece[i] else -1 - i for i in p)}
                right = {int(data[i + size]) if i + size < end[i] else -1 - i for i in p}
                if len(p) > 1 and len(left) > 1 and len(right) > 1:
                    want[size, tuple(p)] = True
        assert got == set(want)


# ----- 4 quality


def test_quality_on_held_out_rows_and_odd_rows(spark, odd, empty):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    out = rows(quality.quality_of_documents(docs, labels).join(labels, "doc_id").where("held_out"))
    good, bad = [r["score"] for r in out if r["quality"] == 1], [r["score"] for r in out if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (4, 0), (5, None), (9, 1)], "doc_id long, quality int")
    scored = rows(quality.quality_of_documents(odd, marks))
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] == 0.5 for r in rows(quality.quality_of_documents(odd, marks.limit(0))))
    assert rows(quality.quality_of_documents(empty, marks)) == []


def test_quadratic_discriminant_equals_the_written_out_density():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.array([0] * 200 + [1] * 300)
    m = quality.fit_arrays(x, y, shrink=0.0, ridge=0.0)
    z = (x - m.center) / m.scale
    want = []
    for c in (0, 1):
        p = z[y == c]
        s = np.cov(p.T, bias=True)
        d = z - p.mean(axis=0)
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    assert np.allclose(m.log_ratio(x), want[1] - want[0])
    assert quality.fit_arrays(x, np.ones(500, int)).score(x[:2]).tolist() == [1.0, 1.0]


# ----- 5 SimHash


def brute_components(keys, linked):
    n = len(keys)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [keys[find(i)] for i in range(n)]


def test_fingerprints_and_components_equal_brute_force(docs, odd, empty):
    import xxhash

    out = sorted(rows(simhash.components_of_documents(docs)), key=lambda r: r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out[:40]:
        words = texts[r["doc_id"]].encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        assert int(r["fingerprint"], 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fp = [int(r["fingerprint"], 16) for r in out]
    assert [r["component_id"] for r in out] == brute_components([r["doc_id"] for r in out], lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    got = rows(simhash.components_of_documents(odd))
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == "0" * 16 and by[8]["component_id"] == 1 and by[5]["component_id"] == 4 and by[None]["component_id"] is None
    assert rows(simhash.components_of_documents(empty)) == []


def test_fingerprints_of_one_document_are_in_one_component(spark):
    a, b = "one two three four five six", "quite other words stand here now"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (8, "alone in its own group of words")], "doc_id long, text string")
    out = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows(simhash.components_of_documents(df))}
    assert len(out) == 5 and {k[0]: v for k, v in out.items()} == {3: 3, 5: 3, 7: 3, 8: 8} and set(out.values()) == {3, 8}


def test_of_rows_with_one_id_the_same_one_stays(spark):
    data = [(1, "a text of words that is here only once", "x"), (4, "first text of this repeated number", "p"), (4, "second text of this repeated number, longer", "q"), (4, "first text of this repeated number", "r")]
    kept = []
    for order in (data, data[::-1], data[1:] + data[:1]):
        df = spark.createDataFrame(order, "doc_id long, text string, out string").repartition(3)
        kept.append(sorted(tuple(r) for r in simhash.keep_representatives(df).collect()))
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 4]


def test_pruning_fingerprints_lose_no_pair_at_the_similarity():
    rng = np.random.default_rng(12)
    budget, most = simhash.prune_budget(0.8), 0
    for n in (33, 45, 90, 300):
        for _ in range(300):
            shared, own = math.ceil(n * 0.8), n - math.ceil(n * 0.8)
            a = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
            b = np.concatenate([a, rng.integers(0, 1 << 63, own, dtype=np.uint64)])
            x = simhash.fingerprint(a, simhash.PRUNE_WORDS) ^ simhash.fingerprint(b, simhash.PRUNE_WORDS)
            most = max(most, int(np.bitwise_count(x).sum()))
            assert simhash._linked(x[None], np.zeros(1, int), budget).all()
    assert most < budget


@pytest.mark.parametrize("depth", [1, 3, 5, 7])
def test_chain_keys_lose_no_link(spark, depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(8)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, [int(np.uint64(f).astype(np.int64))]) for i, f in enumerate(fps)], "node long, fp array<long>")
    want = brute_components(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for cell in (8192, 3):  # 3: keys dealt over block pairs
        found = {r["node"]: r["component"] for r in rows(cc.components(simhash.links(nodes, cell, depth), Workspace(spark, "t")))}
        assert [found.get(i, i) for i in range(len(fps))] == want


def test_near_copies_go_and_other_documents_stay(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)) for _ in range(60)]
    near = []
    for t in texts[:20]:
        w = t.split()
        for k in rng.choice(200, 3, replace=False):
            w[k] = "changed"
        near.append(" ".join(w))
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts + near + texts[:5])], SCHEMA)
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in rows(kept)) == list(range(60))


def _overlapping(rng, common):
    """Two texts of distinct words, of 204 shingles each, that share ``common`` of them."""
    a = [f"w{rng.integers(1 << 40)}" for _ in range(208)]
    b = a[: common + 4] + [f"w{rng.integers(1 << 40)}" for _ in range(204 - common)]
    return [" ".join(a), " ".join(b)]


def test_texts_under_the_similarity_stay(spark):
    rng = np.random.default_rng(8)
    texts = [t for j in (0.5, 0.6, 0.7, 0.78) for _ in range(10) for t in _overlapping(rng, int(204 * 2 * j / (1 + j)))]
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in rows(simhash.keep_representatives(df))) == list(range(len(texts)))


def test_texts_at_the_similarity_go(spark):
    rng = np.random.default_rng(10)
    word = lambda: f"w{rng.integers(1 << 40)}"
    pairs = []
    for _ in range(200):  # 5 and 4 shingles: similarity 0.8
        a = [word() for _ in range(9)]
        pairs += [" ".join(a), " ".join(a[:8])]
    for _ in range(20):  # equal sets, other repeats
        a = [word() for _ in range(30)]
        pairs += [" ".join(a * 2), " ".join(a * 9)]
    for _ in range(30):
        pairs += _overlapping(rng, 182)
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(pairs)], SCHEMA)
    assert sorted(r["doc_id"] for r in rows(simhash.keep_representatives(df))) == list(range(0, len(pairs), 2))


def test_similar_forest_equals_brute_force():
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in rng.integers(1, 40, 25)]
    sets = [b[rng.random(len(b)) > p] for b in base for p in (0, 0.05, 0.15, 0.3)]
    want = brute_components(list(range(len(sets))), lambda i, j: len(np.union1d(sets[i], sets[j])) and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8)
    a, b = simhash.similar_forest(sets, np.arange(len(sets)), 0.8)
    root = dict(zip(a.tolist(), b.tolist()))
    assert [root.get(i, i) for i in range(len(sets))] == want


def test_keep_representatives_on_odd_rows(odd, empty):
    kept = simhash.keep_representatives(odd)
    assert sorted(str(r["doc_id"]) for r in rows(kept)) == sorted(["1", "3", "4", "7", "9", "None"])
    assert rows(simhash.keep_representatives(empty)) == []


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in rows(cc.components(spark.createDataFrame(chain, "a long, b long"), Workspace(spark, "t")))}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}


@pytest.mark.parametrize("broadcast", [True, False])
def test_cells_of_hot_keys_hold_every_pair_once(spark, monkeypatch, broadcast):
    from lattiq.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 100 if broadcast else 0)
    df = spark.createDataFrame([("hot", i) for i in range(30)] + [("cold", 99)], "k string, m long")
    cells = {}
    for r in rows(split_hot(df, "k", "m", 7)):
        cells.setdefault((r["k"], r["cell_i"], r["cell_j"]), []).append((r["m"], r["own"]))
    pairs = [tuple(sorted((a, b))) for (k, i, j), members in cells.items() for x, (a, oa) in enumerate(members) for b, ob in members[:x] if i == j or oa != ob]
    assert len(pairs) == len(set(pairs)) == 30 * 29 // 2


# ----- 6 token store


def test_wavelet_matrix_access_rank_select():
    rng = np.random.default_rng(6)
    for ids in (rng.integers(0, 49000, 5000), np.full(130, 7), rng.integers(0, 3, 64), np.zeros(0, int)):
        ids = ids.astype(np.uint32)
        m = token_store.Shard.from_bytes(token_store.Shard([1, None], np.array([1, 1]), 1, token_store.WaveletMatrix.build(ids)).to_bytes()).matrix
        assert np.array_equal(m.decode(), ids)
        if len(ids):
            at = rng.integers(0, len(ids), 50)
            assert np.array_equal(m.access(at), ids[at])
            token = int(ids[3])
            assert m.count(token) == (ids == token).sum() and m.rank(token, 40) == (ids[:40] == token).sum()
            assert np.array_equal(m.occurrences(token), np.flatnonzero(ids == token)) and m.count(60000) == 0
            with pytest.raises(IndexError):
                m.select(token, m.count(token))


def test_bounds_come_from_select_and_ids_are_probed_by_access(monkeypatch):
    rng = np.random.default_rng(7)
    parts = [np.append(rng.integers(0, 40, int(n)), 1).astype(np.uint32) for n in rng.integers(0, 3000, 60)]
    marks = np.array([(p == 1).sum() for p in parts])  # end ids inside documents too
    shard = token_store.Shard.from_bytes(token_store.Shard(list(range(60)), marks, 1, token_store.WaveletMatrix.build(np.concatenate(parts))).to_bytes())
    assert shard.ends().tolist() == np.cumsum([len(p) for p in parts]).tolist()
    whole = np.concatenate(parts)
    assert np.array_equal(shard.matrix.access(np.arange(len(whole))), whole)
    for plane, before in zip(shard.matrix.bits, shard.matrix.before):  # the directory is read, not made anew
        bits = np.unpackbits(plane, bitorder="little")
        assert before.tolist() == [0, *np.cumsum(bits.reshape(-1, 512).sum(axis=1)).tolist()]
    broken = [b.copy() for b in shard.matrix.before]
    broken[0][1:] += 1
    wrong = token_store.WaveletMatrix(shard.matrix.alphabet, shard.matrix.n, shard.matrix.bits, broken)
    assert not np.array_equal(wrong.access(np.arange(len(whole))), whole)


def test_tokens_equal_the_library_and_offsets_run_on(docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    for df in (docs, odd):
        got = sorted(rows(token_store.tokens_of_documents(df, BPE)), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in rows(df)), key=lambda x: (x is not None, x))
        want, at = {}, 0
        for r in rows(df):
            ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
            want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
        for r in got:
            assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
            at += r["n_tokens"]
    assert rows(token_store.tokens_of_documents(empty, BPE)) == []


def test_word_by_word_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    texts = ["I'LL it's '' don't!'s 12,3 a-b", "ÀÉÎ ß Ŀ İ ǅ", "x\x1cy z", "<|endoftext|> a<|startoftext|>b", "é ́x ΑΣ σς", "½ ² ٣", "", "'s", " nbsp　"]
    flat, counts = token_store.encode_texts(texts, BPE, None)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# ----- the session


def test_operators_leave_the_session_as_it_is(spark, docs):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for f in (simhash.components_of_documents, suffix_dedup.deduplicated_documents, langid.language_of_documents, lambda d: token_store.tokens_of_documents(d, BPE), media.media_of_documents):
        f(docs)
        assert [spark.conf.get(n) for n in names] == before


# ----- 7 mixing


def test_mix_meets_targets_and_odd_rows(spark, docs, odd, empty):
    for df in (docs, odd):
        out = rows(mixing.mixture_of_documents(df))
        size = {}
        assert len(out) == df.count()
        for r in out:
            assert 0 <= r["taken"] <= 3 * r["size"]
        source = {}
        for r in rows(mixing.mix(df)):
            s = source.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
            s[0] += r["taken"]
            s[1] += r["size"]
        total = sum(s[1] for s in source.values())
        assert all(abs(s[0] - s[2]) <= 1 and s[1] == s[3] and s[2] <= 3 * s[3] + 1e-6 for s in source.values())
        assert abs(sum(s[2] for s in source.values()) - total) < 1e-6 * max(total, 1)
        assert out == rows(mixing.mixture_of_documents(df)) and size == {}
    assert rows(mixing.mixture_of_documents(empty)) == []
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_targets_equal_resharing_by_hand(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 500, None: 7, "e": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    order = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    want, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            want.update(share)
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
            open_.discard(k)
    got = {r["source"]: r["target"] for r in rows(mixing.targets(df))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_positions_invert_the_demand_and_order_keeps_columns(docs, odd):
    for r in rows(mixing.mix(docs))[:200]:
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
    out = mixing.training_order(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert {r["doc_id"] for r in rows(out)} <= {r[0] for r in ODD}


# ----- 8 media


def test_codecs_by_their_definitions():
    t = media.tables()
    assert t["mulaw"][0xFF] == 0 and t["mulaw"][0x00] == -32124 and t["mulaw"][0x80] == 32124
    assert t["alaw"][0xD5] == 8 and t["alaw"][0x55] == -8 and t["alaw"][0xAA] == 32256 and t["alaw"][0x2A] == -32256
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 36 * 50).astype(np.uint8).tobytes()
    want = []
    for k in range(0, len(data), 36):
        b = data[k : k + 36]
        value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        want.append(value)
        for byte in b[4:]:
            for nibble in (byte & 15, byte >> 4):
                s = media.STEP[index]
                diff = (s >> 3) + (s if nibble & 4 else 0) + (s >> 1 if nibble & 2 else 0) + (s >> 2 if nibble & 1 else 0)
                value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
                index = max(0, min(88, index + media.INDEX_CHANGE[nibble & 7]))
                want.append(value)
    assert media.decode_adpcm(data).tolist() == want
    assert media.resample(np.array([0, 10, -10], np.int16)).tolist() == [0, 5, 10, 0, -10, -10]
    assert media.resample(np.array([0, 9, 3], np.int16), 3, 1).tolist() == [0, 3, 6, 9, 7, 5, 3, 3, 3]
    with pytest.raises(ValueError):
        media.unpack(b"RIFX")


def test_media_round_trip(docs, odd, empty):
    for df in (docs, odd):
        out = rows(media.media_of_documents(df))
        want = {}
        for r in rows(df):
            b = (r["text"] or "").encode()
            p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
            want.setdefault(r["doc_id"], []).append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        assert len(out) == df.count()
        same = {}
        for r in out:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
            assert same.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
        for r in rows(df):  # the feature ends in what is stored as PCM
            p = media.payload_of(r["text"])[1]
            codec = media.CODECS[zlib.crc32(p) % 3]
            pcm = media.decode(codec, p).astype(int)
            at = np.arange(len(pcm) // 4) * 4
            feature = same[hashlib.sha256(p).hexdigest()][1]
            assert feature.startswith(f"codec={codec};n={len(pcm)};") and feature.endswith(f";pcm={len(at)},{zlib.crc32(pcm[at].astype('<i2').tobytes()):x}")
    assert rows(media.media_of_documents(empty)) == []
    for codec in media.CODECS:
        assert media.unpack(media.pack(b"\x01\x02" * 288, codec)) == (codec, b"\x01\x02" * 288)


def test_media_stores_pcm_at_twice_the_rate(docs, odd, monkeypatch):
    written, write = [], Workspace.write

    def spy(self, df, name, *a, **b):
        out = write(self, df, name, *a, **b)
        if name.startswith("pcm"):
            written.extend(bytes(r["pcm"]) for r in out.select("pcm").collect())
        return out

    monkeypatch.setattr(Workspace, "write", spy)
    for df in (docs.repartition(6), odd):
        written.clear()
        want = []
        for r in rows(df):
            p = media.payload_of(r["text"])[1]
            pcm = media.decode(media.CODECS[zlib.crc32(p) % 3], p).astype(int)
            after = np.append(pcm[1:], pcm[-1:])
            want.append(np.stack([pcm, (pcm + after) // 2], axis=1).astype("<i2").tobytes())
        out = rows(media.media_of_documents(df))
        assert sorted(written) == sorted(want)
        assert sorted((r["pcm_samples"], r["pcm_crc32"]) for r in out) == sorted((len(w) // 2, zlib.crc32(w)) for w in want)


# ----- 9 embeddings


def brute_links(vectors, threshold=0.98):
    ok = [i for i, (_, v, label) in enumerate(vectors) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(vectors))}
    for a in ok:
        for b in ok:
            if a < b and vectors[a][2] == vectors[b][2] and len(vectors[a][1]) == len(vectors[b][1]):
                x, y = (np.array(vectors[k][1], float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a].add(b), links[b].add(a)
    comp = brute_components([v[0] for v in vectors], lambda i, j: j in links[i])
    return {(v[0], len(links[i]), comp[i], v[0] == comp[i]) for i, v in enumerate(vectors)}


@pytest.mark.parametrize("cell", [4096, 5])
def test_embedding_links_equal_brute_force(spark, cell):
    rng = np.random.default_rng(9)
    vectors = []
    for c in range(12):
        center = rng.normal(size=16)
        vectors += [(center + rng.normal(scale=0.05, size=16) * rng.random()).tolist() for _ in range(12)]
    rowsin = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(500, vectors[0], 0), (501, vectors[0], 0), (502, [0.0] * 16, 0), (503, None, 0), (504, [1.0, None], 0), (505, [float("nan")] * 16, 0), (506, vectors[0], None), (507, [float("inf")] * 16, 1), (508, [], 1), (509, [1.0, 2.0], 1), (510, [2.0, 4.0], 1), (511, [2.0 * x for x in vectors[0]], 0)]
    df = spark.createDataFrame(rowsin, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as copies", "'x' as code")
    out = embed_dedup.link_vectors(df, cell=cell)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["vec_id"] == r["component_id"]) for r in rows(out)}
    assert got == brute_links(rowsin)


def test_embedding_table_and_empty(spark):
    e = table(spark, SF, "embeddings")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(embed_dedup.near_duplicate_vectors(e))}
    assert got == brute_links([(r["vec_id"], r["embedding"], r["label"]) for r in e.collect()])
    assert rows(embed_dedup.near_duplicate_vectors(e.limit(0))) == []


def test_estimates_are_unbiased_and_inside_their_bounds():
    rng = np.random.default_rng(10)
    x = embed_dedup.unit(rng.normal(size=(300, 64)))
    codes, factors = embed_dedup.binary_codes(x)
    a, b = np.nonzero(~np.eye(300, dtype=bool))
    est, bound = embed_dedup.pair_estimates(embed_dedup.quantised(x), codes, factors, 64, a, b)
    true = (x @ x.T)[a, b]
    assert abs((est - true).mean()) < 0.005 and (np.abs(est - true) <= bound).all()


# ----- 10 SentencePiece


def test_pieces_equal_the_library_and_round_trip(docs, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd):
        out = rows(sentencepiece_codec.pieces_of_documents(df, PIECES))
        assert len(out) == df.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
        want = {}
        for r in rows(df):
            want.setdefault(r["doc_id"], []).append(sp.encode(r["text"] or ""))
        assert all(r["ids"] in want[r["doc_id"]] for r in out)
    assert rows(sentencepiece_codec.pieces_of_documents(empty, PIECES)) == []


def test_unigram_viterbi_equals_brute_force():
    rng = np.random.default_rng(11)
    pieces = [("▁", -3.0), *((c, -4.0) for c in "abc"), *{("".join(rng.choice(list("abc"), int(rng.integers(2, 5)))), -float(rng.random() * 8)) for _ in range(25)}]
    pieces = list(dict(pieces).items())
    m = sentencepiece_codec.PieceModel(pieces=pieces)
    score = dict(pieces)

    def best(word):
        top = {0: (0.0, [])}
        for j in range(1, len(word) + 1):
            for i in range(j):
                s = score.get(word[i:j], m.floor if j - i == 1 else None)
                if i in top and s is not None and (j not in top or top[i][0] + s > top[j][0]):
                    top[j] = (top[i][0] + s, top[i][1] + [word[i:j]])
        return top[len(word)]

    words = ["".join(rng.choice(list("abcx"), int(rng.integers(1, 12)))) for _ in range(60)]
    flat, sizes = m.encode_words(words)
    for w, ids in zip(words, np.split(flat, np.cumsum(sizes)[:-1])):
        total = sum(m.scores[i] if i else m.floor for i in ids)
        assert math.isclose(total, best(w)[0], abs_tol=1e-9)
