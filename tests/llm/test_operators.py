"""Operators against brute force on small tables, with nulls, empty and repeated rows, and clashing columns."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import attention, common, decontam, langid, mixing, quality, queries, scoring, sharding, simhash, substrings, urls, warc
from tessera.llm.attention import Model
from tessera.llm.common import id_crc
from tessera.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, f long, root long"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"w{i}" for i in range(120))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, copies, near copies, repeated rows, shared passages; columns named like the operators' own."""
    texts = [BASE, BASE, None, "", " \t\n", LONG, "x " + LONG + " y", LONG.replace("w60", "zz"), BASE.upper(), "é ü ñ", BASE + " and more", "a", LONG + " " + LONG]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", len(t or ""), i, i) for i, t in enumerate(texts)]
    rows += [(5, LONG, "en", "src1", 1, 5, 5), (None, LONG, None, None, None, None, None), (3, "other text under a used id", "en", "src0", 1, 1, 1)]
    return spark.createDataFrame(rows, DOCS).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def components(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(40)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components([e for e in edges if e[0] != e[1]], nodes)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 1


def test_sharding_moves_only_into_the_new_shard(spark, odd, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_table(docs, 40).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    assert sharding.shard_table(odd).count() == odd.count() and sharding.shard_table(none).count() == 0


def test_shard_is_the_best_of_all(spark):
    """Against a loop over shards in plain Python; the hashes are Spark's."""
    for weights in ([1.0] * 5, [1.0, 2.0, 0.5, 0.0, 7.0]):
        hashes = [F.xxhash64(F.col("id").cast("string"), F.lit(i)).alias(f"h{i}") for i in range(5)]
        for r in spark.range(500).select(*hashes, sharding.rendezvous(F.col("id"), weights).alias("shard")).collect():
            tops = [(r[i] & (2**64 - 1)) >> 11 for i in range(5)]
            assert r.shard == max((-w / math.log((u + 0.5) / 2**53), u, i) for i, (w, u) in enumerate(zip(weights, tops, strict=True)) if w)[2]


def test_no_move_between_shards_whose_weights_stay(spark):
    keys = spark.range(20000)

    def shard(weights):
        return [r.s for r in keys.select("id", sharding.rendezvous(F.col("id"), weights).alias("s")).orderBy("id").collect()]

    for old, new in (([1.0] * 3, [1.0, 1.0, 1.0, 2.0]), ([1.0] * 3, [1.0, 1.0, 1.0, 0.0]), ([1.0, 2.0, 3.0], [1.0, 2.0]), ([1.0, 1.0, 1.0], [1.0, 4.0, 1.0]), ([2.0, 1.0, 1.0], [2.0, 1.0, 0.25])):
        wide = max(len(old), len(new))
        stays = {i for i in range(wide) if old[i : i + 1] == new[i : i + 1]}
        moved = [(a, b) for a, b in zip(shard(old), shard(new), strict=True) if a != b]
        assert not any(a in stays and b in stays for a, b in moved)
        assert bool(moved) == (new[3:] != [0.0])


def test_weighted_shards(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"))
    n = Counter(r.shard for r in sharding.assign_shards(keys, weights=[1.0, 3.0, 0.0]).collect())
    assert n[2] == 0 and abs(n[1] / 20000 - 0.75) < 0.02
    with pytest.raises(ValueError, match="weights"):
        sharding.assign_shards(keys, weights=[0.0])


# 2


def test_covering_masks_lose_no_pair():
    m = [x & (2**64 - 1) for x in simhash.masks(3)]
    r = np.random.default_rng(2)
    for _ in range(3000):
        d = sum(1 << int(b) for b in r.choice(64, r.integers(1, 4), replace=False))
        assert any(not (d & x) for x in m)


def brute_groups(rows):
    fps = {f: min((i for i, g in rows if g == f and i is not None), default=None) for f in {f for _, f in rows}}
    us = sorted(f & (2**64 - 1) for f in fps)
    root = components([(a, b) for i, a in enumerate(us) for b in us[:i] if (a ^ b).bit_count() <= 3], us)
    low = defaultdict(list)
    for f, i in fps.items():
        if i is not None:
            low[root[f & (2**64 - 1)]].append(i)
    return {f: min(low[root[f & (2**64 - 1)]], default=None) for f in fps}


def test_simhash_groups(spark, odd, none, sf):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        got = simhash.near_groups(docs).collect()
        want = brute_groups([(r.doc_id, r.fp) for r in got])
        assert len(got) == docs.count() and all(r.component == want[r.fp] for r in got)
    assert simhash.fingerprint(b"") == 0 and simhash.near_groups(none).count() == 0


def test_hot_fingerprints(spark):
    """Fingerprints above and below a 4,096th of the rows; every row comes back once."""
    rows = [(i, "the very same words again and again") for i in range(3000)] + [(3000 + i, f"one{i} two{i} three{i} four{i}") for i in range(6000)]
    df = spark.createDataFrame([*rows, (None, "the very same words again and again")], "doc_id long, text string")
    got = [(r.doc_id, r.component) for r in simhash.near_groups(df).collect()]
    assert Counter(i for i, _ in got) == Counter([None, *range(9000)])
    assert all(c == 0 for i, c in got if i is None or i < 3000)
    fps = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    assert all(c == i or (fps[c] ^ fps[i]).bit_count() <= 3 for i, c in got if i is not None and i >= 3000)


def test_fingerprint_bit_by_bit(sf, duck):
    import xxhash

    texts = [t for (t,) in duck.sql("select text from documents limit 60").fetchall()] + ["", "One", "one TWO", "a b c\tA b C \x0b a", "\u00c9 \u00a0 x", None]
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words, word = [], ""
        for c in low + " ":
            if c in " \t\n\x0b\x0c\r":
                words, word = words + [word] * bool(word), ""
            else:
                word += c
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(None if t is None else t.encode()) == want


def test_dense_bucket_in_chunks(spark):
    r = np.random.default_rng(3)
    fps = sorted({int(sum(1 << int(b) for b in r.choice(20, 4, replace=False))) for _ in range(400)})
    pairs = simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), chunk=64).collect()
    root = components([(p.src, p.dst) for p in pairs], fps)
    assert root == components([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3], fps)


def test_near_dedup(spark, odd, none, sf):
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5, 9, 11]
    assert simhash.near_dedup(none).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    stay = {r.doc_id for r in simhash.near_dedup(docs).collect()}
    ids = sorted(text)
    near = {(a, b) for i, a in enumerate(ids) for b in ids[:i] if simhash.jaccard(text[a], text[b], 5) >= 0.8}
    group = components(near, ids)
    assert all(group[i] != i for i in ids if i not in stay)  # nothing clean goes
    assert not any(a in stay and b in stay for a, b in near)


def test_near_dedup_goes_by_fingerprints(spark, monkeypatch):
    """Without the prefix join, groups are those of fingerprint links that the exact check lets stand."""
    r = np.random.default_rng(11)
    base = [[f"w{x}" for x in r.integers(0, 10**6, 1500)] for _ in range(6)]
    texts = [" ".join(w) for b in base for w in (b, [*b[:750], "changed", *b[751:]], [*b, "more"])]
    texts += ["same bits", "SAME  bits", "\t", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    fps = [simhash.fingerprint(t) for t in raw]
    near = {(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3 and simhash.jaccard(raw[a], raw[b], 5) >= 0.8}
    group = components(near, range(len(texts)))
    assert sum(group[a] != a for a in group) >= 8
    monkeypatch.setattr(simhash, "_in_buckets", lambda *_: spark.createDataFrame([], "src long, dst long"))
    roots = {r.key: r.root for r in simhash.similar_groups(docs, "doc_id", "text").collect()}
    assert all((roots[a] == roots[b]) == (group[a] == group[b]) for a in roots for b in roots)
    far = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "node long, text string")  # equal bits, unlike texts: candidates, no group
    monkeypatch.setattr(simhash, "fingerprint", lambda *_: 5)
    assert [tuple(x) for x in simhash.fingerprint_pairs(far).collect()] == [(1, 2)]


def test_appended_and_reordered_copies(spark):
    """Similar texts that word-set fingerprints miss, and many texts of the same words of which few are similar."""
    r = np.random.default_rng(7)
    word = lambda n, p: [f"{p}{x}" for x in r.integers(0, 10**6, n)]
    texts = []
    for i in range(30):
        base = word(int(r.integers(100, 300)), "w")
        texts += [base, base + word(int(len(base) * (0.08, 0.15, 0.22)[i % 3]), "foreign"), base[int(len(base) * 0.15) :]]
    bag = word(60, "v")
    texts += [list(r.permutation(bag)) for _ in range(20)]
    for b in [list(r.permutation(bag)) for _ in range(6)]:
        texts += [b, b[1:] + b[:1], b[3:] + b[:3]]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {(a, b) for a in range(len(texts)) for b in range(a) if simhash.jaccard(texts[a].encode(), texts[b].encode(), 5) >= 0.8}
    group = components(near, range(len(texts)))
    for chunk in (4096, 4):
        roots = {r.key: r.root for r in simhash.similar_groups(docs, "doc_id", "text", chunk=chunk).collect()}
        assert all((roots[a] == roots[b]) == (group[a] == group[b]) for a in roots for b in roots)
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == set(group.values())


# 3


def test_model_is_a_distribution():
    net = Model(6, 8, 4, seed=1)
    total = sum(10.0 ** net.log10([np.array(x, np.int32)])[0] for n in range(3) for x in np.ndindex(*[5] * n))
    one = [10.0 ** net.log10([np.array(x, np.int32)])[0] for x in np.ndindex(5, 5)]
    assert 0 < total < 1 and len(one) == 25
    texts = [np.arange(40, dtype=np.int32) % 5, np.array([], np.int32), np.array([1, 2], np.int32)]
    assert np.allclose(net.log10(texts), [net.log10([t])[0] for t in texts], rtol=1e-5)  # batching changes nothing


def test_gradients():
    net, texts = Model(40, 8, 4, seed=1), [np.array([1, 5, 7, 2] * 9, np.int32), np.array([3], np.int32)]
    g, _, n = net.gradients(texts)
    for name, x in net.p.items():
        i = np.unravel_index(np.abs(g[name]).argmax(), x.shape)
        old, loss = x[i], []
        for step in (1e-2, -1e-2):
            x[i] = old + step
            loss.append(net.gradients(texts)[1])
        x[i] = old
        assert abs((loss[0] - loss[1]) / 2e-2 / n - g[name][i]) < 1e-4 + 0.05 * abs(g[name][i])


def slow_log10(net, ids):
    """One position after the other, each looking back at its own block and the one before."""
    p, end, w, total = net.p, net.v - 1, net.width, 0.0
    x, y = [end, *ids], [*ids, end]
    for t in range(len(x)):
        back = range(max(0, (t // attention.BLOCK - 1) * attention.BLOCK), t + 1)
        s = np.exp([p["q"][x[t]] @ p["key"][x[j]] + p["far"][t - j] for j in back])
        mixed = (s / s.sum()) @ np.array([p["val"][x[j]] for j in back])
        h = np.maximum(p["own"][x[t]] + p["prev"][x[t - 1] if t else end] + mixed @ p["out"] + p["b"], 0)
        for level in range(attention.LEVELS):
            node, branch = y[t] // w ** (attention.LEVELS - level), y[t] // w ** (attention.LEVELS - 1 - level) % w
            e = np.exp(h @ p[f"w{level}"][node] + p[f"b{level}"][node] + net.pad[level][node])
            total += math.log10(e[branch] / e.sum())
    return total


def test_attention_against_loops():
    r = np.random.default_rng(6)
    net = Model(70, 8, 4, logs=np.log(np.arange(1, 71) / 2485), seed=2)
    for name in net.p:
        net.p[name] = net.p[name] + r.normal(0, 0.2, net.p[name].shape).astype(np.float32)
    texts = [r.integers(0, 69, n).astype(np.int32) for n in (0, 1, 5, 31, 32, 33, 64, 150)]
    assert np.allclose(net.log10(texts), [slow_log10(net, t) for t in texts], rtol=1e-4)


def test_windows_change_nothing():
    """Long texts are scored in overlapping windows, each place once, as in the whole text; peak memory doesn't grow with the text."""
    import tracemalloc

    net, r = Model(70, 8, 4, seed=2), np.random.default_rng(6)
    texts = [r.integers(0, 69, n).astype(np.int32) for n in (0, 31, 32, 63, 64, 65, 127, 128, 500)]
    whole = net.log10(texts, 10_000)
    for most in (32, 64, 100, 128):
        for t in texts:
            parts = list(attention.windows(t, most))
            assert sum(n for _, (_, n) in parts) == len(t) + 1 and max(len(p) for p, _ in parts) <= most + 2 * attention.BLOCK
        assert np.allclose(net.log10(texts, most), whole, rtol=1e-5)
    peaks = []
    for n in (100_000, 800_000):
        long = r.integers(0, 69, n).astype(np.int32)
        tracemalloc.start()
        net.log10([long])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_no_look_ahead():
    """What is known of a place doesn't change with what comes later."""
    net, r = Model(30, 8, 4, seed=5), np.random.default_rng(1)
    a = r.integers(0, 29, 100).astype(np.int32)
    for cut in (0, 1, 31, 32, 70, 99):
        b = a.copy()
        b[cut:] = r.integers(0, 29, 100 - cut)
        rows = []
        for t in (a, b):
            x, place, _, _, first = net.layout([t])
            rows.append(net.hidden(x, place, first)[0][: cut + 1])
        assert np.allclose(rows[0], rows[1], atol=1e-6)


def test_better_than_the_base_on_held_out_texts(spark):
    """On the smallest tables, 140,000 training subwords, the base is better: the model has to spell words it never saw."""
    out = queries.op3_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] / out[2] > out[1] / out[2] + 0.05


def test_full_subword_cache():
    ids, logs = list(range(200, 700)), {b"the": -1.0, b"and": -2.0}
    words = [f"word{i % 90}".encode() for i in range(400)] + [b"the", "\u00e9\u00df".encode(), b"and", b"the"]
    sub, one = scoring.Subwords(scoring.TOKENIZER, ids, 502, logs, size=20), scoring.encoder(scoring.TOKENIZER)
    for i in range(0, len(words), 7):
        part = words[i : i + 7]
        at = sub.places(part)
        want = [sub.rank[x] for w in part for x in one([w])[0]]
        assert sub.ids(at).tolist() == want and len(sub.at) <= 20 + len(part)
        assert [x for x in sub.known[at] if x < 0] == [logs[w] for w in part if w in logs]
    assert sub.places([]).tolist() == [] and sub.ids(sub.places([])).tolist() == []


def test_training_takes_all_words():
    import pyarrow as pa

    sub = scoring.Subwords(scoring.TOKENIZER, list(range(200, 700)), 502)
    texts = [LONG.encode(), b"", b"one two", " ".join(f"word{i}" for i in range(25_000)).encode()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    got = list(scoring._pieces(iter([batch]), sub, 1000))
    want = [sub.ids(sub.places(t.split())) for t in texts]
    assert np.concatenate(got).tolist() == np.concatenate(want).tolist() and max(map(len, got)) <= 1000


def test_words_of_batches():
    import pyarrow as pa

    r = np.random.default_rng(2)
    letters = [b"a", b"B", "\u00c9\u00df".encode(), b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x00", "\u00a0".encode(), b"\xff"]
    texts = [b"".join(letters[i] for i in r.integers(0, len(letters), n)) for n in r.integers(0, 40, 500)] + [None, b"", b"  ", b" a b ", b"long " * 5000]
    for kind in (pa.binary(), pa.large_binary()):
        got = []
        for part in scoring.slices(pa.array([b"before", *texts], kind).slice(1), 1000):
            words, codes, sizes = scoring.coded(part)
            assert len(set(words.to_pylist())) == len(words) and sizes.sum() == len(codes)
            for c in np.split(codes, np.cumsum(sizes)[:-1]):
                got.append([words[int(i)].as_py() for i in c])
        assert got == [scoring.words_of(t) for t in texts]
    assert list(scoring.slices(pa.array([], pa.binary()))) == []


def test_texts_are_split_once(spark):
    """The written ids, which training and scoring read, are those of all words of each text; so are the base's parts."""
    texts, logs = [LONG, "", None, " One two\tthe the zebra ", "word " * 30_000, "the"], {b"the": -1.0, b"word": -2.0}
    ids = list(range(200, 700))
    words = spark.sparkContext.broadcast(("once", scoring.TOKENIZER, ids, 502, logs))
    body = spark.createDataFrame([(i, i != 1, None if t is None else t.encode()) for i, t in enumerate(texts)], "doc long, learn boolean, text binary")
    sub = scoring.Subwords(scoring.TOKENIZER, ids, 502)
    rows = {r.doc: r for r in scoring.code_texts(body, words, -0.5).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], scoring.words_of((t or "").encode())
        assert np.frombuffer(r.ids, np.uint16).tolist() == sub.ids(sub.places(want)).tolist() and r.learn == (i != 1)
        assert (r.n_tokens, r.n_known) == (len(want) + 1, sum(w in logs for w in want))
        assert abs(r.base - sum(logs.get(w, 0) for w in want) + 0.5) < 1e-6 * len(want) + 1e-9
        assert {bytes(w): n for w, n in zip(r.tail, r.times, strict=True)} == Counter(w for w in want if w not in logs)


def test_sums_by_token():
    net, r = Model(300, 8, 4), np.random.default_rng(3)
    ids, rows = np.minimum(r.integers(0, 299, 2000), r.integers(0, 299, 2000)).astype(np.int32), r.normal(size=(2000, 5)).astype(np.float32)
    want = np.zeros((300, 5))
    np.add.at(want, ids, rows)
    order, sums = net._gather(ids)
    assert np.allclose(sums(rows[order]), want, atol=1e-4)


def test_commonest_words_are_bounded(spark):
    counts = {f"w{i}".encode(): 1 + 1000 // (i + 1) for i in range(300)}
    table = spark.createDataFrame(list(counts.items()), "word binary, c long")
    for most in (0, 1, 5, 40, 299, 300, 1000):
        got = {bytes(r.word): r.c for r in scoring.commonest(table, most).collect()}
        others = [c for w, c in counts.items() if w not in got]
        assert len(got) <= most and all(counts[w] == c for w, c in got.items()) and min(got.values(), default=1e9) > max(others, default=0)
    assert len(scoring.commonest(table, 300).collect()) == 300 and len(scoring.commonest(table, 1).collect()) == 1
    assert scoring.commonest(table.where("c < 0"), 5).count() == 0


def test_rare_subwords_and_far_context_count(spark):
    a, b = np.arange(40, dtype=np.int32), np.arange(40, dtype=np.int32)
    b[10] = 60
    net = Model(90, 8, 4, seed=1)
    far = [net.log10([x[:40]])[0] - net.log10([x[:39]])[0] for x in (a, b)]
    assert abs(far[0] - far[1]) > 1e-6  # a token 28 places back
    texts = [" ".join(f"{x}{i}" for i in range(400)) for x in ("\u00e9t\u00e9", "zebra", "q\u00fc", "Stra\u00dfe", "x7")] + [BASE, LONG]
    words = spark.createDataFrame([(w.encode(), 1) for t in texts for w in t.lower().split()], "word binary, c long")
    used = {i for t in texts for x in scoring.encoder(scoring.TOKENIZER)(scoring.words_of(t.encode())) for i in x}
    got = scoring._commonest_ids(words, scoring.TOKENIZER, scoring.SETTINGS["vocabulary"] - 2)
    assert {i for i, _ in got} == used and scoring.SETTINGS["vocabulary"] - 2 == scoring.ALL_IDS


def test_base_scores(spark, odd, none):
    learn = id_crc("doc_id", 5) != 1
    small = {"warm_tokens": 5000, "vocabulary": 200, "head_words": 5}
    got = scoring.score(odd, learn, **small).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in odd.collect()]
    teach = [w for i, w in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(x for w in teach for x in w)
    n, v = sum(c.values()) + len(teach), len(c) + 1
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((-1 if i is None else i, len(w) + 1, sum(x in c for x in w) + 1, round(sum(log(c[x]) for x in w) + log(len(teach)), 6)) for i, w in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert scoring.score(none, learn, **small).count() == 0


# 4


def slow_distance(p, t):
    row = list(range(len(p) + 1))
    best = len(p)
    for x in t:
        new = [0]
        for j, y in enumerate(p, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers_and_pigeonhole():
    r = np.random.default_rng(5)
    for _ in range(60):
        p, t = ("".join(r.choice(list("abc"), n)) for n in (int(r.integers(1, 70)), int(r.integers(0, 120))))
        assert min(decontam.myers(decontam.char_masks(p), len(p), t, len(p))[0], len(p)) == slow_distance(p, t)
    item = "".join(r.choice(list("abcdefgh "), 100))
    for _ in range(200):
        s = list("".join(r.choice(list("abcdefgh "), 60)) + item + "".join(r.choice(list("abcdefgh "), 60)))
        for _ in range(int(r.integers(0, 9))):
            s[int(r.integers(50, 170))] = str(r.choice(["", "x", "ab"]))
        text = "".join(s)
        found = decontam.Matcher([(7, item)], 0.06).find(text)
        want = slow_distance(item, text)
        assert bool(found) == (want <= 6) and (not found or found[0][1] == want)


def test_decontaminate(spark, odd, none):
    bench = spark.createDataFrame([(1, LONG[:100]), (2, "short"), (3, None), (4, "an item that nobody has copied anywhere at all so far")], "item_id long, text string")
    kept = decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 3, 4, 8, 9, 10, 11]
    table = decontam.leak_table(odd, bench).collect()
    assert len(table) == odd.count() and {r.item_id for r in table} == {1, None}
    assert decontam.decontaminate(none, bench).count() == 0 and decontam.decontaminate(odd, bench.limit(0)).count() == odd.count()

def test_short_and_equal_items(spark):
    texts = ["Tell me: what is 2 + 2?", "somewhat is 2 25", "\u5b66\u751f\u5728\u5317\u4eac\u5927\u5b66\u8bfb\u4e66", "none", LONG, "what is 2", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, "What is 2 + 2"), (2, "\u5317\u4eac\u5927\u5b66"), (3, LONG[:100]), (4, LONG[:100].upper() + "!"), (5, "?!"), (6, "what is 2 2"), (6, "what is 2 2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.distance or 0) for r in decontam.leak_table(docs, bench).collect())
    assert got == [(0, 1, 0), (0, 6, 0), (1, 0, 0), (2, 2, 0), (3, 0, 0), (4, 3, 0), (4, 4, 0), (5, 0, 0), (6, 0, 0)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [1, 3, 5, 6]


# 5


def test_warc_round_trip(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 90\r\n\r\n"
    rows = [(1, "http://a/", fake), (2, None, None), (3, "http://b/\r\nx", ""), (4, "u", "é" * 5000), (5, "u", "é" * 5000), (6, "u", fake + "x"), (None, "n", "only"), (7, "z", fake)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.new_path(spark, "t")
    warc.write_archives(pages, path, records_per_file=5)
    got = {r.id: r for r in warc.read_archives(spark, path, block=200).collect()}
    assert set(got) == {r[0] for r in rows}
    firsts = {2: 2, 3: 2, 4: 4, 5: 4, 1: 1, 7: 1}
    for i, _, html in rows:
        body = (html or "").encode()
        r, first = got[i], firsts.get(i, i)
        assert r.record_type == ("response" if first == i else "revisit") and r.refers_to == (None if first == i else first)
        assert r.payload_bytes == len(body) and r.digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload == (body if first == i else None)
    assert warc.round_trip(pages.limit(0)).count() == 0

def test_warc_long_headers(spark):
    rows = [(i, "http://a/" + "u" * n, f"page {i}") for i, n in enumerate((10, 65_600, 300_000, 5, 131_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.new_path(spark, "t")
    warc.write_archives(pages, path)
    got = {r.id: (r.url, r.payload.decode()) for r in warc.read_archives(spark, path, block=100_000).collect()}
    assert got == {i: (u, h) for i, u, h in rows}


# 6


def test_water_filling(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 5)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.target for r in mixing.leaf_targets(leaves, {}, (1, 2), 1).collect()}
    # b can give 5 of 503; of a's 1002 half to x and y; of x's 501 source 1 has only 10
    assert got == {"4": 5, "1": 10, "2": 491, "3": 501}


def test_mix(spark, odd, none):
    out = mixing.mix(odd, {}, {}, epochs=1)
    assert out.columns == odd.columns and 0 < out.count() < odd.count()
    twice = mixing.plan_mixture(odd, {}, {}, share=(2, 1), epochs=2)
    assert twice.count() == 2 * odd.where("text is not null and btrim(text, ' \\t\\n') <> ''").count()
    assert mixing.mix(none, {}, {}).count() == 0


# 7


def test_aliases(spark):
    link = '<link rel="canonical" href="{}"><p>'
    rows = [
        (1, "http://a.com/en/1", ""), (2, "http://x.test/1", link.format("http://a.com/en/1")), (3, "http://x.test/2", '<meta http-equiv="refresh" content="0; url=/1">'),
        (4, "http://y.test/", link.format("http://q.net/de/1")), (5, "http://z.test/", ""), (6, None, link.format("http://a.com/en/1")), (7, "no scheme", None), (8, "http://b.net/de/2", link.format("http://a.com/en/1")), (1, "http://a.com/en/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages.where("page_id <> 8"), queries.URL_RULES).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow")}
    # with an allowed member the aliases are allowed, the blocked page itself isn't
    more = {r.page_id: r.verdict for r in urls.judge_urls(pages, queries.URL_RULES).collect()}
    assert (more[1], more[2], more[8]) == ("block", "allow", "allow")


# 8


def test_quality_cascade(spark, odd, none):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count()
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.filter_quality(none).count() == 0 and quality.judge(none).count() == 0
    assert sorted(quality.order_rules(odd.select("text"), {"a": "text is null", "b": "true"})) == ["a", "b"]
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 9


def test_substrings(odd, none):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in odd.collect()]
    first = {}
    for i, w in rows:
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(x for x in (first.get(k), i) if x is not None) if i is not None or k in first else None
    want = []
    for i, w in rows:
        keep = [True] * len(w)
        for j in range(len(w) - 49):
            f = first[tuple(w[j : j + 50])]
            if i is not None and f is not None and f < i:
                keep[j : j + 50] = [False] * 50
        want.append((-1 if i is None else i, len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, y in zip(w, keep, strict=True) if y)).hexdigest()))
    for batches in (1, 3):
        got = substrings.dedup_substrings(odd, batches=batches).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert substrings.dedup_substrings(none).count() == 0


def test_compacted_run_is_joined(spark, odd, monkeypatch):
    merged, plain = [], substrings.SubstringIndex.compact
    monkeypatch.setattr(substrings.SubstringIndex, "compact", lambda self: (merged.append(self.runs), plain(self)))
    rows = [(i, LONG if i % 3 else f"x{i} " + LONG, "en", "s", 1, 1, 1) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    seen = lambda df: sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())
    want, got = seen(substrings.dedup_substrings(docs, batches=1)), seen(substrings.dedup_substrings(docs))
    assert got == want and merged == [4]  # the fifth batch met the merged run


def test_substrings_broadcast_nothing(spark, odd, monkeypatch):
    plans, write, save = [], substrings.written, common.Bucketed._save
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(substrings, "written", lambda df, name: (seen(df), write(df, name))[1])
    monkeypatch.setattr(common.Bucketed, "_save", lambda self, df, mode: (seen(df), save(self, df, mode))[1])
    assert substrings.dedup_substrings(odd, batches=3).count() == odd.count()
    assert sum("SortMergeJoin" in p for p in plans) >= 10 and not any("Broadcast" in p for p in plans)


# 10


def test_language_id(spark, odd, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, id_crc("doc_id", 5) != 0).collect()}
    held = docs.where((id_crc("doc_id", 5) == 0) & (F.col("n_chars") > 40 if "n_chars" in docs.columns else F.length("text") > 40)).collect()
    assert sum(got[r.doc_id] == r.lang for r in held) >= 0.97 * len(held)
    few = langid.identify(odd.select("doc_id", "text", "lang"), F.lit(True)).collect()
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 4)) for r in few if r.doc_id not in (3, None)) and all(0 <= r.score <= 1 for r in few)
    assert langid.identify(none.select("doc_id", "text", "lang"), F.lit(True)).count() == 0


def test_sample_of_copies(spark):
    texts = ["alpha beta", "gamma delta", "one more text"]
    rows = [(i, texts[i % 3], "aa") for i in range(6000)] + [(i, "zu wem", "bb") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, rows_per_lang=300)
    enc = langid.Encoder()
    units = [v / np.sqrt(v @ v) for v in map(enc.vector, texts)]
    assert sorted(model) == ["aa", "bb"] and model["aa"] @ sum(units) > 0.98 * np.sqrt(sum(units) @ sum(units))
    assert sorted(langid.fit(docs, rows_per_lang=300, languages=1)) == ["aa"]


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing_sources", "shards"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = P.run(spark, sf)
    assert out.columns == [*docs.columns, "shard"]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}


# all


LOUD = "doc_id long, text string, lang string, source string, n_chars long, _rid string, _salt int, score string, lang_pred string, w int, _text string, _epoch int, rid int, f int, part int"


def test_clashing_columns_and_a_long_text(spark):
    """Columns named like the operators' own, two of them nearly the longest text there can be, go through untouched."""
    r = np.random.default_rng(11)
    vast = " ".join(f"v{x}" for x in r.integers(0, 10**6, 200_000))
    texts = [vast, vast + " end", BASE, BASE + " and more", " ".join(f"n{i}" for i in range(100)), None, ""]
    rows = [(i, t, "en", "src1", 1, "rid", 2, "high", "xx", 5, "tt", 6, 7, 8, 9) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, LOUD).coalesce(2)
    bench = spark.createDataFrame([(1, " ".join(f"n{i}" for i in range(30, 60)))], "item_id long, text string")
    loud = {r[0]: tuple(r) for r in rows}

    def check(out, ids):
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == ids and all(tuple(r) == loud[r.doc_id] for r in got)

    check(quality.filter_quality(docs), [0, 1, 2, 3, 4])
    check(simhash.near_dedup(docs), [0, 2, 4, 5])
    check(decontam.decontaminate(docs, bench), [0, 1, 2, 3, 5, 6])
    check(mixing.mix(docs, {}, {}, share=(1, 1), epochs=1), [0, 1, 2, 3, 4])
    assert sharding.assign_shards(docs).drop("shard").columns == docs.columns
    assert {r.doc_id for r in sharding.shard_table(docs).collect()} == set(loud)
    groups = {r.doc_id: r.component for r in simhash.near_groups(docs).collect()}
    assert groups[1] == 0 and groups[6] == groups[5] == 5
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(docs, batches=2).collect()}
    assert removed[0] == (200_000, 0) and removed[1] == (200_001, 200_000) and removed[3][1] == 0
    langs = langid.identify(docs, F.lit(True)).collect()
    assert {r.lang_pred for r in langs} == {"en", "und"} and all(r._rid == "rid" and r.w == 5 for r in langs)
    scores = {r.doc_id: r for r in scoring.score(docs, F.col("doc_id") > 1, warm_tokens=5000).collect()}
    assert scores[0].n_tokens == 200_001 and -2e7 < scores[1].score < scores[0].score < -10_000 and scores[5].score == scores[6].score


def test_blocks_of_a_benchmark(spark):
    texts = ["Tell me: what is 2 + 2?", LONG, "x " + LONG[:100].upper(), "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, "What is 2 + 2"), (2, "what IS 2 2"), (3, LONG[:100]), (4, LONG[:100].upper() + "!"), (5, LONG[:101]), (6, LONG[30:140]), (7, "what is, 2, 2?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items) / (1 << 20)
    seen = [sorted((r.doc_id, r.item_id or 0, r.distance or 0) for r in decontam.leak_table(docs, bench, block_mb=size / n).collect()) for n in (1, 3, 10)]
    assert seen[0] == seen[1] == seen[2] and {x[1] for x in seen[0]} == {0, 1, 2, 3, 4, 5, 6, 7}


def test_warc_payload_full_of_magic(spark):
    fake = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, "http://a/", fake * n + str(i)) for i, n in enumerate((0, 500, 1, 2000, 0, 30))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.new_path(spark, "t")
    warc.write_archives(pages, path)
    assert {r.id: r.payload.decode() for r in warc.read_archives(spark, path, block=1000).collect()} == {i: h for i, _, h in rows}


def test_judge_names_the_base_rule(spark):
    rows = quality.judge(spark.createDataFrame([(1, "a b"), (2, BASE), (3, (BASE + " ") * 4), (4, BASE.upper() + " A"), (5, None)], "doc_id long, w string"), text="w").collect()
    assert {r.doc_id: r.rejected_by for r in rows} == {1: "short", 2: None, 3: "repeats", 4: "capitals", 5: "short"}
    assert all(r.base_failed == (r.rejected_by in ("short", "repeats")) and r.kept == (r.rejected_by is None) for r in rows)
