"""The corpus operators against brute force, and on null, empty, long, tied and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litsieve.llm import anchors, embeddings, media, packing, pieces, preferences, sharding, simhash, suffix_dedup, toxicity, url_filters
from litsieve.llm.common import components, ranked

#: Columns that operators use inside, so that a clash would show.
EXTRA = ["k", "n", "h", "c", "lo", "m", "spans", "node", "link", "shard", "rank", "label", "score", "size", "bucket", "length", "fp", "k_", "SPANS_", "__k", "__n", "__spans", "__score", "rest", "slices", "own"]


def docs(spark, texts, ids=None):
    """Documents with clashing extra columns; ids may repeat or be null."""
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def words(rnd, n, low=3):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(low, 9))) for _ in range(n))


ODD = [None, "", " \n\t", "word", "same text here", "same text here", "é日本 ｆ", "a" * 9000, "x " * 4000, "\0\x1c", "The END. the end"]
ODD_IDS = [0, 1, 2, 3, 4, 4, 6, 7, 8, None, 10]


# ---- suffix dedup ---------------------------------------------------------------------------------------


def plain_removal(texts, length):
    count = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        mask = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = [True] * length
        kept = bytes(x for x, gone in zip(b, mask, strict=True) if not gone)
        runs = sum(g and (i == 0 or not mask[i - 1]) for i, g in enumerate(mask))
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(seed):
    rnd = random.Random(seed)
    shared = [words(rnd, 30) for _ in range(4)]
    out = []
    for _ in range(25):
        parts = [words(rnd, rnd.randrange(0, 40)) for _ in range(3)]
        parts.insert(rnd.randrange(3), rnd.choice(shared)[rnd.randrange(5) :])
        out.append(" ".join(parts))
    out += [out[0], out[0][:-7], "ab" * 300, "b" * 200 + "ab" * 150]
    return out


@pytest.mark.parametrize("hot", [1, 4096])
def test_repeats_against_brute_force(spark, hot):
    texts = repeated_texts(hot) + ODD
    length = 60
    keyed = docs(spark, texts, range(len(texts)))
    rows = keyed.select("doc_id", "text")
    spans = suffix_dedup.repeated_spans(rows.where("text is not null").select("text"), length, width=40, hot=hot)
    by_text = {(bytes(r.k), r.n): r.spans for r in spans.collect()}
    keys = {r.doc_id: (bytes(r.k), r.n) if r.k is not None else None for r in rows.select("doc_id", *suffix_dedup.text_key(F.col("text"))).collect()}
    for i, (text, want) in enumerate(zip(texts, plain_removal(texts, length), strict=True)):
        found = by_text.get(keys[i], ())
        kept, runs = suffix_dedup._kept((text or "").encode(), found)
        assert (len((text or "").encode()), len((text or "").encode()) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) == want


def test_repeats_report_and_odd_rows(spark):
    texts = ODD + ["q" * 50 + t for t in repeated_texts(3)]
    got = suffix_dedup.removal_report(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain_removal(texts, 400)
    kept = suffix_dedup.remove_repeats(docs(spark, ODD, ODD_IDS))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(ODD)
    assert suffix_dedup.removal_report(docs(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_repeated_passages_are_counted_and_stay(spark):
    rnd = random.Random(51)
    passage = words(rnd, 52, 4)[:390]  # over 50 words, under 400 bytes
    long = words(rnd, 130)
    texts = [f"{words(rnd, 40)} {passage} {words(rnd, 30)}", f"{words(rnd, 9)} {passage}", words(rnd, 90)]
    texts += [f"{words(rnd, 20)}é{long[i:]} {words(rnd, 20)} {passage} {long[: 300 + i]}" for i in range(3)]
    texts += [long[:399], long[7:407], passage * 2, texts[0], f"{words(rnd, 5)} {texts[0]}", None, "", "x" * 199, "y" * 200, "z" * 201, "z" * 450]
    got = suffix_dedup.removal_report(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain_removal(texts, 400)
    assert [(r.n_bytes, r.n_passage_bytes, r.n_passages) for r in got] == [x[:3] for x in plain_removal(texts, 200)]
    assert (got[1].n_removed, got[1].n_passages, got[2].n_passages) == (0, 1, 0)
    # touching passages whose union is long enough, though no string of 400 bytes repeats
    a, b = words(rnd, 80)[:250], words(rnd, 80)[:250]
    got = suffix_dedup.removal_report(docs(spark, [a + b, f"{a}#", f"{b}#"])).orderBy("doc_id").first()
    assert (got.n_removed, got.n_passage_bytes, got.n_passages) == (0, 500, 1)
    with pytest.raises(ValueError):
        suffix_dedup.removal_report(docs(spark, texts), 100)


def test_deep_shallow_orders_suffixes():
    rnd = random.Random(1)
    base = ("ab" * 40 + words(rnd, 30) + "ab" * 40 + words(rnd, 5)).encode()
    data = base + base[10:150] + b"\0\0" + base[:70]
    starts = np.array(rnd.sample(range(len(data)), 150))
    ends = np.minimum(starts + 90, len(data))
    order, longest = suffix_dedup.deep_shallow(data, starts, ends)
    suffixes = [data[a:b] for a, b in zip(starts, ends, strict=True)]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    for i, s in enumerate(suffixes):
        best = max(next((k for k in range(min(len(s), len(t))) if s[k] != t[k]), min(len(s), len(t))) for j, t in enumerate(suffixes) if j != i)
        assert longest[i] == (best if best >= suffix_dedup.SHALLOW else longest[i]) and (best >= suffix_dedup.SHALLOW or longest[i] <= best)


def test_anchors_depend_on_the_window_alone():
    rnd = random.Random(2)
    texts = [words(rnd, 60).encode(), b"a" * 300, words(rnd, 2).encode(), words(rnd, 90).encode()]
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    owner, lo, hi, anchor = anchors.window_anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), starts, sizes, 50, 20)
    found = {}
    for o, a, b, x in zip(owner, lo, hi, anchor, strict=True):
        for w in range(a, b + 1):
            found[int(w)] = int(x - w)
            assert starts[o] <= w and w + 50 <= starts[o] + sizes[o]
    assert len(found) == sum(max(0, n - 49) for n in sizes)
    whole = b"".join(texts)
    for w, off in found.items():
        one = np.frombuffer(whole[w : w + 50], dtype=np.uint8)
        _, _, _, alone = anchors.window_anchors(one, np.array([0]), np.array([50]), 50, 20)
        assert alone[0] == off


# ---- toxicity ---------------------------------------------------------------------------------------------


def toxic_corpus(n, seed=0):
    rnd = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        bad = rnd.random() < 0.3
        parts = words(rnd, rnd.randrange(5, 60)).split()
        for _ in range(rnd.randrange(1, 4) if bad else 0):
            parts.insert(rnd.randrange(len(parts)), rnd.choice(["zorkish", "Grumphead"]))
        texts.append(" ".join(parts))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_held_out(spark):
    texts, labels = toxic_corpus(500)
    marks = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)] + [(None, 1, 0), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.judge(docs(spark, texts), marks).collect()}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2] and len(held) > 80
    right = np.mean([got[i].predicted == labels[i] for i in held])
    assert right > 0.97
    odd = toxicity.judge(docs(spark, ODD, ODD_IDS), marks.where("doc_id < 0"))
    assert {r.score for r in odd.collect()} == {0.5} and odd.count() == len(ODD)
    assert toxicity.judge(docs(spark, []), marks).count() == 0
    kept = toxicity.drop_toxic(docs(spark, texts + ODD), marks)
    assert kept.columns == docs(spark, []).columns
    gone = set(range(len(texts))) - {r.doc_id for r in kept.collect()}
    assert gone == {i for i in range(len(texts)) if got[i].predicted}


def test_whole_texts_are_read(spark):
    """A toxic word at the very end of a text of several blocks counts."""
    place = np.full(toxicity.BUCKETS, -1, dtype=np.int16)
    short = "zzzzz"
    (bucket, fits), *_ = toxicity._grams(*(lambda b: (b[0], b[2]))(next(toxicity._blocks([short]))))
    place[bucket[2]] = 0
    long = "a " * toxicity.BLOCK + short
    assert [len(x) for x in toxicity._present(place, [long, "a b", short])][::2] == [1, 1]


# ---- embeddings -------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(40)] + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.05, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (404, rows[0][1], None), (405, rows[0][1], rows[0][2]), (406, [1.0, 2.0], 1), (407, [], 0), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("cid", "copies", "codes", "table", "root", "usable")})
    good = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links, root = {}, {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(good):
        for b in good[:i]:
            x, y = np.array(a[1]), np.array(b[1])
            if a[2] == b[2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[id(a)] = links.get(id(a), 0) + 1
                links[id(b)] = links.get(id(b), 0) + 1
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)
    want = sorted((r[0], links.get(id(r), 0), find(r[0]), find(r[0]) == r[0]) for r in rows)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.embedding_links(df).collect()) == want
    assert embeddings.embedding_links(df.where("false")).count() == 0


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (1 + rng.standard_normal(8) * 1e-3)], 1) for i in range(100)]
    got = embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all((r.n_links, r.component_id) == (99, 0) for r in got)


# ---- SimHash ----------------------------------------------------------------------------------------------


def plain_fingerprint(text, width):
    import re

    import xxhash

    found = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    shingles = [b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("rows_of_a_shard", [8, 8192])
def test_simhash_against_brute_force(spark, monkeypatch, rows_of_a_shard):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 4)
    monkeypatch.setattr(simhash.near_edges, "__defaults__", (2, None, rows_of_a_shard))
    rnd = random.Random(5)
    texts = list(ODD)
    for _ in range(30):
        base = words(rnd, rnd.randrange(3, 200)).split()
        for _ in range(rnd.randrange(1, 5)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "Changed"
            texts.append(" ".join(copy))
    prints = [plain_fingerprint(t, 3) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = simhash.simhash_groups(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.fingerprint, r.component_id) for r in got] == [(f"{p:016x}", find(i)) for i, p in enumerate(prints)]


def test_simhash_null_and_repeated_ids(spark):
    got = simhash.simhash_groups(docs(spark, ["a b c d", "a b c d", "e", None], [None, 5, None, 2])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (2, 2), (5, 5)]
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_tree_search_is_exact():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    fp = np.concatenate([fp, fp[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))])
    for bands, radius in ((1, 3), (2, 3), (4, 3), (1, 14)):
        pairs = set()
        for band in range(bands):
            values = simhash._slice(fp, band, bands)
            simhash._search(values, fp, np.arange(len(fp)), np.arange(len(fp)), radius, radius // bands, lambda a, b: pairs.update(zip(a.tolist(), b.tolist(), strict=True)))
        want = {(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius)}
        assert pairs == want


def test_similar_groups(spark):
    rnd = random.Random(8)
    base = [words(rnd, 300, 4).split() for _ in range(6)]
    texts = [" ".join(b) for b in base]
    near = [" ".join([*b[:100], "other", *b[101:]]) for b in base[:4]]
    far = [" ".join(b[:150] + words(rnd, 150, 4).split()) for b in base]
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts + near + far + [texts[5], "", None, "one"])).collect()}
    assert [groups[6 + i] for i in range(4)] == [0, 1, 2, 3]
    assert [groups[10 + i] for i in range(6)] == list(range(10, 16))
    assert groups[16] == 5 and groups[18] == groups[17] == 17 and groups[19] == 19
    many = docs(spark, ODD, ODD_IDS)
    kept = simhash.keep_first(many, simhash.similar_groups(many))
    assert kept.columns == many.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 3, 4, 6, 7, 8, 10]


def shingle_sets(texts, width=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def similar_pairs(sets, least=0.8):
    """All pairs of different sets at ``least`` or more, by an index over all shingles."""
    where, unique = {}, list(dict.fromkeys(sets))
    for i, s in enumerate(unique):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(unique):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= least * (len(s) + len(unique[j]) - n) - 1e-9:
                yield s, unique[j]


def held_against_sets(texts, groups):
    """(share of the similar pairs that stand in one group, whether groups are no larger than links make them)."""
    sets = shingle_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first, pairs = {}, list(similar_pairs(sets))
    for i, s in enumerate(sets):
        root[i] = find(first.setdefault(s, i))
    for a, b in pairs:
        x, y = find(first[a]), find(first[b])
        root[max(x, y)] = min(x, y)
    found = [groups[first[a]] == groups[first[b]] for a, b in pairs]
    exact = all(find(i) == find(groups[i]) for i in range(len(texts)))
    return np.mean(found) if found else 1.0, exact, len(found)


def test_similar_groups_recall(spark):
    rnd = random.Random(21)
    texts = []
    line = words(rnd, 30, 4)
    for k in range(160):  # pairs from about 0.6 to 0.95, a line that all share
        base = words(rnd, 250, 4).split()
        copy = list(base)
        for at in rnd.sample(range(5, 245), 1 + k // 16):
            copy[at] = "other"
        texts += [" ".join(base) + " " + line, line + " " + " ".join(copy)]
    text, again = words(rnd, 300, 4), words(rnd, 20, 4)
    texts += [text + " " + again, text + (" " + again) * 60]  # few shingles more, counted 60 times
    chain = words(rnd, 200, 4).split()
    for k in range(60):  # a chain whose ends are far apart
        chain = [*chain[4:], *words(rnd, 4, 4).split()]
        texts.append(" ".join(chain))
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    recall, exact, pairs = held_against_sets(texts, groups)
    assert groups[321] == 320 and pairs > 300 and recall >= 0.95 and exact


def test_similar_groups_on_a_table(spark):
    """Recall and exactness on a whole table of the test data, held against all pairs."""
    import os

    path = os.environ.get("TEST_DOCUMENTS", "/root/testdata/sf0.01/documents.parquet")
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = spark.read.parquet(path).select("doc_id", "text").orderBy("doc_id")
    texts = {r.doc_id: r.text for r in rows.collect()}
    ids = list(texts)
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(rows).collect()}
    recall, exact, _ = held_against_sets(list(texts.values()), [ids.index(groups[i]) for i in ids])
    assert recall >= 0.9 and exact


def test_slices_are_simhash():
    """Slices are those of plainly counted fingerprints, and sets at 0.8 differ in about 0.15 of the bits."""
    rng = np.random.default_rng(22)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 2, 9, 500)]
    got, words_of = simhash.set_slices(np.concatenate(sets), np.array([len(s) for s in sets]), 22, 28)
    assert words_of.shape == (5, 9) and not words_of[0].any()
    for s, row in zip(sets, got, strict=True):
        words_ = [anchors.mix64(s + np.uint64(w + 1) * simhash._STEP).view(np.uint8).reshape(-1, 8) for w in range(10)]
        bits = np.concatenate([np.unpackbits(w, axis=1) for w in words_], axis=1).sum(axis=0) * 2 > len(s)
        assert [int("".join(map(str, bits[22 * i : 22 * i + 22].astype(int))), 2) if len(s) else 0 for i in range(28)] == [int(f"{v:022b}"[::-1], 2) for v in row.tolist()]
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    two, whole = simhash.set_slices(np.concatenate([base[:1800], base[200:]]), np.array([1800, 1800]), 32, 64)
    apart = np.bitwise_count((two[0] ^ two[1]).astype(np.uint64)).sum()
    assert 0.12 < apart / 2048 < 0.18 and apart == np.bitwise_count((whole[0] ^ whole[1]).view(np.uint64)).sum()


def test_value_pairs_by_trees(spark, monkeypatch):
    """Every pair of slice values one bit apart, once, whatever the shards."""
    monkeypatch.setattr(simhash, "VALUE_ROWS", 16)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 4)
    rng = np.random.default_rng(23)
    rows = [(i, [int(x) for x in rng.integers(0, 1 << 12, 3)]) for i in range(400)]
    nodes = spark.createDataFrame(rows, "node long, slices array<long>")
    values = nodes.select(F.posexplode("slices").alias("table", "value")).distinct()
    got = sorted(tuple(r) for r in simhash._value_pairs(values, nodes, 12, 3).collect())
    want = []
    for t in range(3):
        held = sorted({r[1][t] for r in rows})
        want += [(t, a, b) for a in held for b in held if a < b and (a ^ b).bit_count() == 1]
    assert got == sorted(want)


def test_first_of_a_group_is_settled(spark):
    rows = [(1, "a", "z"), (1, "a", "b"), (1, "c", "q"), (2, "a", "y"), (None, "a", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    groups = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1)], "doc_id long, component_id long")
    got = sorted(map(tuple, simhash.keep_first(df, groups).collect()), key=str)
    assert got == [(1, "a", "b"), (1, "c", "q"), (None, "a", "x"), (None, "a", "x")]
    bare = df.select("text", "doc_id")
    assert simhash.keep_first(bare, groups).columns == ["text", "doc_id"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SentencePiece ----------------------------------------------------------------------------------------


def test_pieces_are_the_library_s(spark):
    import sentencepiece

    rnd = random.Random(9)
    texts = ODD + ["  lead", "trail  ", "a  b\n\tc ", "\n\n", "▁a", "😀 ok", "\U0010ffff z", "日本語" * 300, "q" * 700]
    texts += ["".join(rnd.choice("ab  e\nthing日.,é") for _ in range(rnd.randrange(1, 300))) for _ in range(60)]
    texts += ["".join(chr(rnd.randrange(32, 0x3000)) for _ in range(300)) for _ in range(5)]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    encoded = pieces.encode_pieces(docs(spark, texts))
    rows = {r.doc_id: r for r in pieces.decode_pieces(encoded).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == model.encode(t or "")
        assert rows[i].decoded == (t or "").replace("▁", " ")
    assert pieces.encode_pieces(docs(spark, [])).count() == 0
    none = encoded.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r.decoded for r in pieces.decode_pieces(none).collect()} == {""}


def test_long_stretches_alone(monkeypatch):
    """The queue and the steps side by side give the same."""
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("thinger") for _ in range(150)) for _ in range(20)]
    step = pieces.Encoder(pieces.model_path())(pa.array(texts))
    monkeypatch.setattr(pieces, "LONG", 4)
    again = pieces.Encoder(pieces.model_path())(pa.array(texts))
    assert all(np.array_equal(a, b) for a, b in zip(step, again, strict=True))


def test_stretches_without_a_free_character():
    texts = ["", " ", "a", " a", "a ", "a  b   c", "  a  ", "a b"]
    every = "".join(map(chr, range(0xFDD0, 0xFDF0)))
    plain = pieces.stretches(pa.array(texts)).to_pylist()
    assert [x or [] for x in plain] == pieces.stretches(pa.array([*texts, every])).to_pylist()[:-1]
    assert [" ".join(x or []) for x in plain] == texts


def test_memory_of_chunks_is_bounded():
    words_ = packing.WordIds(packing.vocabulary_path(), room=50)
    rnd = random.Random(15)
    texts = [words(rnd, 40) for _ in range(8)]
    whole = packing.WordIds(packing.vocabulary_path())
    for t in texts:
        assert np.array_equal(words_(pa.array([t]))[0], whole(pa.array([t]))[0])
        assert len(words_._chunks._number) <= 50 + 40 * 3


# ---- preferences ------------------------------------------------------------------------------------------


def test_preferences(spark):
    turns = [
        (0, 0, "user", "Hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "good"),
        (1, 0, "user", "Hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "bad<|im_end|>"), (1, 3, "assistant", "bad<|im_end|>"),
        (2, 0, None, None), (2, None, "assistant", "x"), (4, 0, "user", "u"), (5, 0, "user", "u"), (None, 0, "user", "u"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("turns", "a", "b", "pair_id", "prompt")})
    got = {r.pair_id: r for r in preferences.format_preferences(df, preferences.neighbour_pairs(df)).collect()}
    r = got[0]
    assert r.prompt_turns == 3 and r.prompt.count("<|im_start|>") == 3 and r.usable
    assert r.chosen == "<|im_start|>assistant\ngood<|im_end|>\n" and r.rejected == "<|im_start|>assistant\nbad<| im_end|><|im_end|>\n"
    assert [r.chosen[s.start : s.stop] for s in r.chosen_mask] == ["good<|im_end|>"]
    assert [r.rejected[s.start : s.stop] for s in r.rejected_mask] == ["bad<| im_end|><|im_end|>"]
    assert not got[1].usable and got[1].rejected_id is None and got[1].chosen == "<|im_start|>assistant\nx<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert not got[2].usable and got[2].prompt_turns == 1 and got[2].chosen == ""
    assert preferences.format_preferences(df.where("false"), preferences.neighbour_pairs(df.where("false"))).count() == 0


# ---- packing ----------------------------------------------------------------------------------------------


def held_by(plan):
    held = {}
    for config, n in plan:
        assert n > 0
        for s, t in config.items():
            held[s] = held.get(s, 0) + t * n
    return held


def test_plan_holds_everything():
    rnd = random.Random(11)
    for capacity, sizes in ((64, range(1, 65)), (50, [7, 13, 26]), (4096, [4096, 1, 2000, 2096]), (4096, [5])):
        histogram = {s: rnd.randrange(1, 60) for s in sizes}
        plan = packing.configurations(histogram, capacity)
        assert all(sum(s * t for s, t in config.items()) <= capacity for config, _ in plan)
        assert held_by(plan) == histogram
        # the volume cannot be reached where few lengths leave gaps
        assert sum(n for _, n in plan) <= 1.02 * sum(n for _, n in packing.best_fit(histogram, capacity)) + 1
    assert packing.configurations({}) == []


def length_table(scale, seed=3):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(np.maximum(rng.lognormal(6.4, 0.9, 1000 * scale).astype(int), 1), 4096)
    return dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))


@pytest.mark.parametrize("scale", [1, 10, 300])
def test_the_program_places_most(monkeypatch, scale):
    """Four fifths of the tokens or more stand where the program put them; no more sequences than best fit, nearly."""
    histogram, shares = length_table(scale), []
    plain = packing.best_fit

    def watched(rest, capacity, begun=()):
        volume = sum(s * n for s, n in histogram.items())
        shares.append(1 - sum(s * n for s, n in rest.items()) / volume)
        return plain(rest, capacity, begun)

    monkeypatch.setattr(packing, "best_fit", watched)
    plan = packing.configurations(histogram)
    assert held_by(plan) == histogram and shares[0] > 0.8
    bins = sum(n for _, n in plan)
    assert bins <= 1.001 * sum(s * n for s, n in histogram.items()) / 4096 + 2
    assert bins <= 1.001 * sum(n for _, n in plain(histogram, 4096)) + 1


def test_fractional_program_meets_demands():
    sizes, demand = np.array([300, 700, 1100, 2500]), np.array([40.0, 30.0, 20.0, 10.0])
    met, used = np.zeros(4), packing.fractional(sizes, demand, 4096)
    for config, amount in used.items():
        assert sum(sizes[i] * t for i, t in config) <= 4096
        for i, t in config:
            met[i] += amount * t
    assert np.allclose(met, demand)
    assert (sizes * demand).sum() / 4096 - 1e-6 <= sum(used.values()) <= 1.05 * (sizes * demand).sum() / 4096 + 1


def test_knapsack_is_best():
    rnd = random.Random(12)
    for _ in range(30):
        sizes = np.array(sorted(rnd.sample(range(1, 30), 4)))
        worth = np.array([rnd.random() for _ in sizes])
        most = np.array([rnd.randrange(0, 6) for _ in sizes])
        best = np.zeros(41)
        for s, w, n in zip(sizes, worth, most, strict=True):
            for _ in range(n):
                best[s:] = np.maximum(best[s:], best[: 41 - s] + w)
        picked = packing.knapsack(sizes, worth, most, 40)
        assert sum(sizes[i] * t for i, t in picked.items()) <= 40 and all(t <= most[i] for i, t in picked.items())
        assert np.isclose(sum(worth[i] * t for i, t in picked.items()), best[40])


def test_packed_pieces(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(13)
    texts = ODD + [words(rnd, rnd.randrange(1, 900)) for _ in range(60)] + ["It's <|endoftext|> <|ENDOFTEXT|> İΣ x\x1cq ﬁ é", "dog's (12)*** l'État--x ÷ß_ÿ don't 3rd…\u00a0end $$$.", "z" * 300_000, "many words " * 30_000]
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack(docs(spark, texts)).collect()
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        whole = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        part = whole[4096 * r.piece : 4096 * (r.piece + 1)]
        assert (r.start, r.length, r.ids_crc32) == (4096 * r.piece, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
        ids[r.doc_id] = ids.get(r.doc_id, 0) + len(part)
    assert sorted(ids) == list(range(len(texts)))
    filled = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
    assert packing.pack(docs(spark, ODD, ODD_IDS)).count() >= len(ODD)
    assert packing.pack(docs(spark, [])).count() == 0


def test_ranked(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("key"), (F.col("id") % 10).alias("tie"))
    got = ranked(df, ["key"], [F.col("tie"), F.col("id")], "place", 7, F.col("id")).collect()
    for key in range(3):
        assert sorted(r.place for r in got if r.key == key) == list(range(sum(r.key == key for r in got)))


# ---- sharding ---------------------------------------------------------------------------------------------


def test_sharding(spark):
    rnd = random.Random(14)
    texts = ODD + [words(rnd, 5) for _ in range(300)]
    texts += [texts[20]] * 3 + [texts[21]] * 2 + ["hot"] * 130
    got = sharding.shard_documents(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    counts, slots, where = {}, {}, {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        counts[r.shard] = counts.get(r.shard, 0) + 1
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sorted(counts) == list(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(where[texts[20]]) == len(where[texts[21]]) == 1
    few = sharding.shard_documents(docs(spark, ODD, ODD_IDS)).collect()
    assert len(few) == len(ODD) and len({r.shard for r in few}) == len(ODD)
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_sharding_gathers_a_hot_text(spark):
    # a text on a third of the rows, one on a twentieth, pairs, and rows on their own or linked in tens
    for rest in (None, 10):
        link = [0] * 800 + [1] * 120 + [2 + i // 2 for i in range(200)]
        link += [None if rest is None else 1000 + i // rest for i in range(1280)]
        nodes = spark.createDataFrame([(i, k) for i, k in enumerate(link)], "node long, link long")
        placed = sharding.propagate(nodes)
        counts, held = {}, {}
        for r in placed.collect():
            counts[r.shard] = counts.get(r.shard, 0) + 1
            held.setdefault(r.link, {}).setdefault(r.shard, []).append(r.node)
        assert len(counts) == 40 and set(counts.values()) == {60}
        pairs = lambda n: n * (n - 1) // 2
        kept = lambda k: sum(pairs(len(v)) for v in held[k].values())
        # 800 rows fill 13 shards of 60 and a third of one, 120 rows two: no other placing keeps more pairs
        assert kept(0) >= 0.95 * (13 * pairs(60) + pairs(20))
        assert kept(1) >= 0.9 * 2 * pairs(60)


def test_sharding_without_movers_takes_no_round(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_gather", lambda *_: pytest.fail("a round"))
    nodes = spark.createDataFrame([(i, None if i % 3 else 1000 + i) for i in range(90)], "node long, link long")
    counts = [r["count"] for r in sharding.propagate(nodes).groupBy("shard").count().collect()]
    assert len(counts) == 40 and sum(counts) == 90 and max(counts) - min(counts) == 1


# ---- urls and media ---------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        "http://a.org/x": ("a.org", "/x", "org/", "allow"),
        "HTTP://WWW.Example.ORG/es/A?q": ("www.example.org", "/es/A", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/2": ("notexample.org", "/es/2", "org/", "allow"),
        "http://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
        "http://com/de/x": ("com", "/de/x", "com/de/", "block"),
        "http://a.com/fr": ("a.com", "/fr", None, "allow"),
        "http://b.org": ("b.org", "", None, "allow"),
        "http://a.com?x://y/": ("a.com", "", None, "allow"),
        "http://cheap-pills.net/de/": ("cheap-pills.net", "/de/", None, "block"),
        "http://x.net/pills/": ("x.net", "/pills/", None, "allow"),
        "http://x.net/a/cart": ("x.net", "/a/cart", None, "block"),
        "http://x.net//cart/2": ("x.net", "//cart/2", None, "block"),
        "http://x.net/carts/a-cart": ("x.net", "/carts/a-cart", None, "allow"),
        "http://a.org/login": ("a.org", "/login", "org/", "allow"),
        "no scheme.org/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "token", "pattern", "html")})
    got = sorted(url_filters.judge_pages(df).collect(), key=lambda r: r.page_id)
    assert [tuple(r) for r in got] == [(i, *v) for i, v in enumerate(cases.values()) for _ in range(2)]
    assert url_filters.judge_pages(df.where("false")).count() == 0


def test_many_url_rules(spark):
    """A hundred thousand rules against every url one by one."""
    rnd = random.Random(12)
    name = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 5)))
    rules = {}
    while len(rules) < 100_000:
        host = ".".join(name() for _ in range(rnd.randrange(1, 3))) + rnd.choice([".org", ".com", ""])
        rule = f"{host}/{rnd.choice(['', name() + '/', name()])}{len(rules) % 7 or ''}"
        rules.setdefault(rule, rnd.choice(["allow", "block"]))
    urls = ["http://" + ".".join(name() for _ in range(rnd.randrange(1, 4))) + rnd.choice([".org", ".com", ""]) + "/" + "/".join(name() for _ in range(rnd.randrange(3))) for _ in range(400)]
    urls += ["http://www." + rule + "x" for rule in rnd.sample(sorted(rules), 100)]
    table = url_filters.rule_table(spark, [url_filters.site_rule(v, r) for r, v in rules.items()])
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filters.judge_pages(df, table.union(table.limit(50))).collect():
        host, _, path = urls[r.page_id].removeprefix("http://").partition("/")
        labels = host.split(".")
        fits = [f"{'.'.join(labels[i:])}/{path[:k]}" for i in range(len(labels)) for k in range(len(path) + 1)]
        found = [f for f in fits if f in rules]
        best = max(found, key=len, default=None)
        same = [f for f in found if len(f) == len(best)]
        best = min(same, key=lambda f: (rules[f] != "block", f), default=None)
        assert (r.rule, r.verdict) == (best, rules.get(best, "allow"))
    assert {r.verdict for r in url_filters.judge_pages(df, table.where("false"), "block").collect()} == {"block"}


def test_media_round_trip(spark):
    texts = ODD + ["x" * n for n in (63, 64, 65, 64 * 64, 64 * 64 + 1, 300000)]
    got = {r.doc_id: r for r in media.media_features(media.encode_media(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        payload, n = media.padded(t)
        raw = (t or "").encode()
        assert n == len(raw) and payload[:n] == raw and len(payload) % 64 == 0 and 0 < len(payload) - n <= 64 or len(payload) == n > 0
        stored = media.write_media(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.duration == len(payload) / 8000 and r.samples == len(payload) // 64
        assert all(payload.startswith(stored[k.start : k.stop]) or stored[k.start : k.stop] in payload for k in r.keyframes)
    assert media.media_features(media.encode_media(docs(spark, []))).count() == 0


def plain_boxes(data, kinds):
    """The bodies of boxes along a path of kinds, found one level after the other."""
    levels = [data]
    for kind in kinds:
        found = []
        for body in levels:
            while body:
                size = int.from_bytes(body[:4], "big")
                if body[4:8] == kind:
                    found.append(body[8:size])
                body = body[size:]
        levels = found
    return levels


@pytest.mark.parametrize("n", [1, 5, 64, 1025, 5000])
def test_media_tables_by_another_reader(n):
    """Sample tables, keyframes and the feature against a reader of its own, table by table."""
    payload = bytes(i * 7 % 251 for i in range(n * 64))
    data = media.write_media(payload)
    (stbl,) = plain_boxes(data, [b"moov", b"trak", b"mdia", b"minf", b"stbl"])
    ints = lambda kind: [int.from_bytes(b[i : i + 4], "big") for (b,) in [plain_boxes(stbl, [kind])] for i in range(4, len(b), 4)]
    assert ints(b"stsz") == [64, n] and ints(b"stts") == [1, n, 64]
    _, *chunks = ints(b"stco")
    many, *runs = ints(b"stsc")
    per = [r for i in range(many) for r in [runs[3 * i + 1]] * ((runs[3 * i + 3] if i + 1 < many else len(chunks) + 1) - runs[3 * i])]
    places = [at + 64 * k for at, m in zip(chunks, per, strict=True) for k in range(m)]
    assert b"".join(data[a : a + 64] for a in places) == payload
    _, *sync = ints(b"stss")
    keys = [(places[i - 1], places[i - 1] + 64) for i in sync]
    assert sync == list(range(1, n + 1, 16))
    told = media._told(data)
    assert [(k["start"], k["stop"]) for k in told[9]] == keys
    assert told[5] == f"soun/raw {n}x64 {64 * n}/8000 keys {len(keys)} {keys[0][0]}-{keys[-1][1]}" and told[6:9] == ("raw ", 64 * n / 8000, n)


def test_media_that_cannot_be_read(spark):
    good = media.write_media(b"x" * 64)
    no_track = b"".join(media._box(k) for k in (b"ftyp", b"moov"))
    no_keys = good.replace(b"stss", b"stsX")
    files = [None, b"", b"\0" * 9, no_track, good[:-70], good.replace(b"stsz", b"stsY"), good]
    df = spark.createDataFrame([(i, 0, f) for i, f in enumerate(files)] + [(6, 0, good)], "doc_id long, n_bytes long, media binary").withColumn("feature", F.lit("x"))
    rows = sorted(media.media_features(df).collect(), key=lambda r: r.doc_id)
    assert [r.feature for r in rows] == [None, *["unreadable"] * 5, *[rows[-1].feature] * 2] and rows[-1].payload_bytes == 64
    assert [r.media_bytes for r in rows] == [None, *(len(f) for f in files[1:]), len(good)] and {r.payload_bytes for r in rows[:6]} == {None}
    assert media._told(no_keys)[5].endswith("keys 1 " + media._told(good)[5].split()[-1])  # without a table of them every sample is one
    none = media._full(b"stss", (0).to_bytes(4, "big"))
    assert none and media.media_features(df.where("false")).count() == 0


def test_large_ids_pair_in_whole_numbers(spark):
    ids = [2**60, 2**60 + 1, 2**53 + 2, 2**53 + 3, -2, -1, 0]
    got = {(r.chosen_id, r.rejected_id) for r in preferences.neighbour_pairs(spark.createDataFrame([(i,) for i in ids], "conv_id long")).collect()}
    assert got == {(2**60, 2**60 + 1), (2**53 + 2, 2**53 + 3), (-2, -1), (0, None)}


def test_media_boxes_are_checked():
    stored = media.write_media(b"a" * 128)
    kinds = [k for k, _, _ in media.boxes(stored, 0, len(stored))]
    assert kinds == [b"ftyp", b"mdat", b"moov"]
    for broken in (stored[:-1], stored[:20], b"\0\0\0\4ftyp"):
        with pytest.raises(ValueError):
            media.read_media(broken)
    with pytest.raises(ValueError):
        media.write_media(b"a")


# ---- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts, labels = toxic_corpus(120, 1)
    rnd = random.Random(2)
    passages = [" ".join(w[:5] for w in words(rnd, 51 + i, 4).split()) for i in range(10)]  # 51 to 60 words
    assert all(250 <= len(p) <= 400 for p in passages)
    held = [f"{words(rnd, 90)} {passages[i % 10]} {words(rnd, 90)}" for i in range(20)]
    texts += [*held, texts[0], *ODD]
    folder = str(tmp_path)
    docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stage, columns = spark.read.parquet(f"{folder}/documents.parquet"), docs(spark, []).columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, folder)
        assert stage.columns == columns
        assert f(spark, docs(spark, []), folder).count() == 0
        assert f(spark, docs(spark, ODD, ODD_IDS), folder).columns == columns
        stage.write.parquet(f"{folder}/{name}")
        stage = spark.read.parquet(f"{folder}/{name}")
    kept = {r.doc_id: r.text for r in stage.collect()}
    assert 140 not in kept
    for i in range(20):
        # the passage is gone, but for what may stand at its edges; the rest of the document is left alone
        before, after = held[i].split(passages[i % 10])
        assert kept[120 + i].startswith(before[:-20]) and kept[120 + i].endswith(after[20:]) and len(kept[120 + i]) <= len(before) + len(after)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs(spark, []), 200, 200)
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)
