"""The byte-pair transducer against plain merging and against the tokenizers library."""

import hashlib
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from litsieve.llm import byte_pairs
from litsieve.llm.packing import vocabulary_path


@pytest.fixture(scope="module")
def encoder():
    return byte_pairs.Encoder(vocabulary_path())


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(vocabulary_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def small_list(rnd, letters="ab", n=40):
    """A merge list over a few letters, each with a form for the end of a word, and bytes that stand for them."""
    tokens = [*letters, *(c + "/" for c in letters)]
    merges = []
    for _ in range(n):
        a = rnd.choice([t for t in tokens if not t.endswith("/")])
        b = rnd.choice(tokens)
        if len(a + b) < 12 and (a, b) not in merges and a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    return byte_pairs.MergeList({t: i for i, t in enumerate(tokens)}, merges, "/", list(letters)), merges


def plain(merges, word):
    """Merging rank by rank over the whole word."""
    parts = [*word[:-1], word[-1] + "/"]
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_stream_is_plain_merging(seed):
    rnd = random.Random(seed)
    listed, merges = small_list(rnd)
    names = {}
    vocab = {t: i for i, t in enumerate([*"ab", "a/", "b/", *(a + b for a, b in merges)])}
    names.update({i: t for t, i in vocab.items()})
    for _ in range(30):
        word = "".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 5, 60, 700])))
        if rnd.random() < 0.3:
            word = rnd.choice(["a", "ab", "aab"]) * (len(word) // 2 + 1)
        machine = byte_pairs.Transducer(listed, ahead=0)
        codes = bytes("ab".index(c) for c in word)
        cut = sorted(rnd.randrange(len(codes) + 1) for _ in range(3))
        told = [t for a, b in zip([0, *cut], [*cut, len(codes)], strict=True) for t in machine.feed(codes[a:b])] + machine.end()
        assert [names[t] for t in told] == plain(merges, word)
        assert machine.window <= listed.lookahead + listed.longest and not machine._held


@pytest.mark.parametrize("seed", range(6))
def test_no_continuation_changes_what_is_stable(seed):
    rnd = random.Random(seed)
    listed, merges = small_list(rnd, n=14)
    for _ in range(200):
        head = "".join(rnd.choice("ab") for _ in range(listed.lookahead + 8))
        ends = [plain(merges, head + "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 20)))) for _ in range(3)]
        for one in ends:
            at = 0
            for i, token in enumerate(one):
                at += len(token.rstrip("/"))
                if at > len(head) - listed.lookahead:
                    break
                assert all(other[i] == token for other in ends)


def test_merges_need_an_order():
    with pytest.raises(ValueError, match="no earlier merge"):
        byte_pairs.MergeList({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")], "", ["a", "b"])


def hostile(rnd):
    alphabet = [chr(c) for c in [*range(0, 256), *range(0x300, 0x330), *range(0x1100, 0x1130), 0x130, 0x3A3, 0x1E9E, 0x2003, 0x3000, 0x65E5, 0x1F600, 0xFF46, 0x661, 0xFFFD, 0x378]]
    pick = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    common = ["the", "it's", "we'LL", "don't", "<|endoftext|>", "<|startoftext|>", "<|", "12", "naïve", "Straße", "éa", "!!!", "'s'"]
    return "".join(rnd.choice([pick(rnd.randrange(6)), rnd.choice(common), rnd.choice([" ", "  ", "\n", ""])]) for _ in range(30))


def texts():
    rnd = random.Random(3)
    long_words = ["a" * 9000, "ab" * 5000, "".join(rnd.choice("etaoinshr") for _ in range(12000)), "日本" * 3000, "!?" * 4000, "0123456789" * 400]
    return [None, "", " \n\t", "\0\x1c", "The END. the end", *long_words, *(hostile(rnd) for _ in range(60))]


def test_ids_are_the_library_s(spark, library):
    given = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "decoded", "n_tokens")})
    df = df.unionByName(df.where("doc_id in (0, 7)"))
    rows = byte_pairs.decode(byte_pairs.encode(df.repartition(3))).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(len(given)), 0, 7])
    for r in rows:
        ids = library.encode(given[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_query_on_a_table(spark, library):
    sf = "/root/testdata/sf0.001"
    told = {r.doc_id: r for r in byte_pairs.op12_bpe_transducer(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        t = told.pop(r.doc_id)
        assert (t.n_tokens, t.ids_sha256, t.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert not told


def test_decoding_to_text(encoder):
    machine = byte_pairs.Decoder(vocabulary_path(), surface=False)
    text = "the naïve 日本 \U0001f600 end"
    ids, _ = encoder(pa.array([text]))
    assert "".join(machine.feed([i]) for i in ids.tolist()) + machine.end() == unicodedata.normalize("NFC", text) + " "
    half = encoder.merges.inner["é".encode()[0]]  # the first of two bytes alone
    assert machine.feed([half]) == "" and machine.end() == "�"
    assert machine.feed([encoder.merges.inner[65], 10**6]) == "A" and machine.end() == ""


def test_empty_tables_and_arrays(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_pairs.decode(byte_pairs.encode(none)).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [None, 320]), (None, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id or 0, r.ids) for r in byte_pairs.decode(odd).collect()) == [(0, []), (1, []), (2, [320])]


def test_memory_of_a_word_is_the_window(encoder):
    machine = byte_pairs.Transducer(encoder.merges)
    most = 0
    for _ in range(60):
        list(machine.feed(b"theabcqx" * 40))
        most = max(most, len(machine._held))
    assert most < machine.window
    assert machine.window == encoder.merges.lookahead + byte_pairs.AHEAD
