import json
import random

import pytest
from pyspark.sql import functions as F

from litsieve.functions import similarity as S
from litsieve.functions import text as T
from litsieve.operators import screening
from litsieve.sources import exports, formats


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


ODD = [" a\t b ", "x y z", "\x1da\x1cb", "", None, "ÀÉ  İ"]


def test_clean_text(spark):
    assert column(spark, ODD, T.clean_text) == [" ".join((v or "").split()) for v in ODD]


def test_normalize_doi(spark):
    values = ["https://doi.org/10.1/AbC", " doi: 10.1/x y", "HTTP://DX.DOI.ORG/10.2/q", "10.3/z.", "", None, "   "]
    assert column(spark, values, T.normalize_doi) == ["10.1/abc", "10.1/x", "10.2/q", "10.3/z.", None, None, None]


def test_title_author_year(spark):
    assert column(spark, ["Déjà-Vu: A (2nd) Look", None, "日本"], T.normalize_title) == ["d j vu a 2nd look", "", ""]
    authors = ["Smith, Jane; Roe, Al", "Jane Smith and Al Roe", "O'Neil, P", "", None, "Müller"]
    assert column(spark, authors, T.first_author) == ["smith", "smith", "oneil", "", "", "mller"]
    assert column(spark, ["2019/03", "c1987", "in 2101", None], T.clean_year) == [2019, 1987, None, None]


def test_index_and_markup(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [2]},)], "m map<string, array<int>>")
    assert df.select(T.rebuild_index(F.col("m"))).first()[0] == "a b c b"
    assert column(spark, ["<jats:p>One  <b>two</b></jats:p>"], T.strip_markup) == ["One two"]


def lcs_plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs(spark):
    import random

    rnd = random.Random(3)
    pairs = [("".join(rnd.choice("abc d") for _ in range(rnd.randrange(14))), "".join(rnd.choice("abc d") for _ in range(rnd.randrange(14)))) for _ in range(120)]
    want = [lcs_plain(a, b) for a, b in pairs]
    assert [S.lcs_length(a, b) for a, b in pairs] == want
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = df.orderBy("i").select(S.lcs("a", "b"), S.lcs_native(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == want
    assert [r[1] for r in rows] == want


def test_prefilter_keeps_all(spark):
    import random

    rnd = random.Random(5)
    pairs = [("".join(rnd.choice("abé ") for _ in range(12)), "".join(rnd.choice("abé ") for _ in range(12))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    reached = S.at_least(S.lcs("a", "b"), F.col("a"), F.col("b"), 83.0)
    assert df.where(reached & ~S.may_reach(F.col("a"), F.col("b"), 83.0)).count() == 0


REPLIES = [
    ('{"rationale":"r","eligible":"T","reason":""}', "T", False),
    ('well {"eligible":"f","reason":"No data"}', "F", False),
    ('{"eligible":true}', "", False),
    ('{"eligible":"T"} x }', "", True),
    ("{'eligible':'T'}", "", True),
    ("no json", "", True),
    ("{bad}", "", True),
    (None, "", False),
    ('{"_api_error":"expired"}', "", False),
    ('{"eligible":"T","eligible":"F"}', "F", False),
    ('{"eligible": NaN, "reason": "x"}', "", False),
    ("}{", "", True),
    ("{}", "", False),
    ('{ }', "", False),
    ('{"eligible":"T",}', "", True),
    ('{"eligible":"T"}\n', "T", False),
    ('{"eligible":null,"reason":null}', "", False),
    ('{"eligible":"\\u0054","reason":0,"rationale":3}', "T", False),
    ('{"eligible":"\xa0t\u3000","reason":" a\xa0"}', "T", False),
    ('{"eligible":"T","x":{"eligible":"F"}}', "T", False),
    ('{"eligible":"T","x":[1,{}]} {', "T", False),
    ('[{"eligible":"T"}]', "T", False),
    ('{"eligible":"T"}{"eligible":"F"}', "", True),
    ('{"a":"tab\there"}', "", True),
    ("{" * 3000 + "}", "", True),
    ('{"a":' * 2000 + "1" + "}" * 2000, "", None),
]


def plain_reply(raw, allowed):
    """The verdict as the rules say it, with Python's own parser."""
    raw = "{}" if raw is None else raw
    begin, end = raw.find("{"), raw.rfind("}")
    try:
        told = json.loads(raw[begin : end + 1]) if 0 <= begin < end else None
    except (ValueError, RecursionError):
        told = None
    e, reason, why = ("" if not told or not told.get(k) else str(told[k]).strip() for k in ("eligible", "reason", "rationale"))
    e = e.upper() if e.upper() in ("T", "F") else ""
    return e, reason, why, told is None, e == "F" and reason not in ("", *allowed), raw[:500]


def test_parse_replies(spark):
    rnd = random.Random(4)
    bits = ['"eligible"', '"reason"', '"T"', '"f"', '"No data"', '"x y"', ":", ":", ",", "{", "}", " ", "null", "1", "true", '"\\n"', "'", "\n"]
    given = [r for r, _, _ in REPLIES] + ["{" + "".join(rnd.choice(bits) for _ in range(rnd.randrange(9))) + "}" for _ in range(400)]
    given += ["{" + ", ".join(f"{rnd.choice(bits[:2])}: {rnd.choice(bits[2:6] + bits[12:15])}" for _ in range(rnd.randrange(1, 4))) + "}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(given)), "record_id long, raw string")
    got = {r.record_id: tuple(r)[1:] for r in screening.parse_replies(df, ["No data"]).collect()}
    for i, raw in enumerate(given):
        assert got[i] == plain_reply(raw, ["No data"]), raw
    for i, (raw, eligible, error) in enumerate(REPLIES):
        assert got[i][0] == eligible and error in (None, got[i][3]), raw
    assert {r.off_vocab_reason for r in screening.parse_replies(df.where("record_id = 1"), []).collect()} == {True}


RIS = """TY  - JOUR
T1  - Alpha takeover study
AU  - Smith, Jane
AU  - Roe, Al
PY  - 2019/03
DO  - DO  - https://doi.org/10.1/AbC
N2  - First line
goes on
ER  -
TY  - JOUR
TI  - Last one
"""
MEDLINE = """PMID- 101
TI  - Alpha takeover
      study
FAU - Smith, Jane
DP  - 2019 Mar 4
LID - 10.1/AbC [doi]
AB  - Text.

PMID- 102
TI  - Beta
"""
BIBTEX = """@article{k1,
  title={Alpha {T}akeover study},
  author="Smith, Jane and Roe, Al",
  year=2019,
  doi={10.1/AbC}
}
@article{k2,
  title={Beta},
  note: broken,
  year={2020}
}
"""


def test_formats():
    entries = formats.ris(RIS)
    assert len(entries) == 2 and ("DO", "https://doi.org/10.1/AbC") in entries[0] and ("N2", "First line goes on") in entries[0]
    assert formats.is_medline(MEDLINE) and not formats.is_medline(RIS)
    entries = formats.medline(MEDLINE)
    assert len(entries) == 2 and ("TI", "Alpha takeover study") in entries[0] and formats.medline_doi(entries[0]) == "10.1/AbC"
    entries = formats.bibtex(BIBTEX)
    assert [dict(e)["title"] for e in entries] == ["Alpha Takeover study", "Beta"]


def test_read_exports(spark, tmp_path):
    (tmp_path / "b.ris").write_text("﻿" + RIS, encoding="utf-8")
    (tmp_path / "a.txt").write_text(MEDLINE)
    (tmp_path / "c.bib").write_text(BIBTEX)
    (tmp_path / "d.csv").write_bytes('DOI,Article Title,Authors,Year\r\n10.5/x,"Caf\x8e, study",Roe Al,NA\r\n'.encode("latin-1"))
    (tmp_path / "e.tsv").write_text("Title\tYear\nOne, two\t2001\n")
    (tmp_path / "f.pdf").write_text("no")
    rows = exports.read_exports(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.record_id for r in rows] == ["a-00000", "a-00001", "b-00000", "b-00001", "c-00000", "c-00001", "d-00000", "e-00000"]
    assert rows[0].doi == rows[2].doi == rows[4].doi == "10.1/abc"
    assert rows[2].first_author == "smith" and rows[2].year == 2019 and rows[2].abstract_source == "export"
    assert rows[6].title == "Café, study" and rows[6].year is None and rows[7].title == "One, two"
    (tmp_path / "a.csv").write_text("Title\nx\n")
    with pytest.raises(ValueError):
        exports.read_exports(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        exports.read_exports(spark, str(tmp_path / "none"))




@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_large_exports_are_cut_at_records(spark, tmp_path, line_end):
    """However small the byte ranges, the records and their numbers are those of the whole file."""
    rnd = random.Random(8)
    ris, medline = ["Provider: x", ""], []
    for i in range(90):
        ris += ["TY  - JOUR", f"T1  - Title {i} é日", "  goes on", f"AU  - Smith{i}, J", f"PY  - {1990 + i % 30}", f"AB  - {'word ' * rnd.randrange(40)}\x0bER  - no", *rnd.choice([["ER  - "], ["ER -"], ["ER  -", ""], ["ER  - rest"]])]
        medline += [f"PMID- {i}", f"TI  - Title {i}", "      goes on", f"AB  - {'word ' * rnd.randrange(40)}", *rnd.choice([[""], ["", ""], ["  "]])]
    ris += ["TY  - JOUR", "T1  - not ended"]
    (tmp_path / "a b%+é[1].ris").write_bytes(("﻿" + line_end.join(ris)).encode() + b"\nN1  - \xff\xfe")
    (tmp_path / "m.txt").write_bytes(line_end.join(medline).encode())
    whole = sorted(tuple(r) for r in exports.read_exports(spark, str(tmp_path)).collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        many = exports.read_tagged(spark, [str(tmp_path / "m.txt")], "medline", "\n\n").select("file")
        assert spark.read.text(str(tmp_path / "m.txt")).rdd.getNumPartitions() >= 7 and many.count() == 90
        cut = sorted(tuple(r) for r in exports.read_exports(spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert cut == whole
    entries = {"a b%+é[1]": formats.ris(formats.decode((tmp_path / "a b%+é[1].ris").read_bytes())), "m": formats.medline((tmp_path / "m.txt").read_text(encoding="utf-8", newline=""))}
    for stem, found in entries.items():
        assert [r[4] for r in whole if r[2] == stem] == [" ".join(" ".join(v for k, v in e if k in ("T1", "TI")).split()) for e in found]


def test_words_indexed_in_the_row(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice(["a", "b", "aa", "é", ""]) for _ in range(rnd.choice([0, 1, 5, 60]))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, words array<string>").withColumn("index_", F.lit(1))
    made = T.word_index(df, "words", "index")
    assert made.columns == ["id", "words", "index_", "index"]
    for r in made.withColumn("text", T.rebuild_index(F.col("index"))).collect():
        assert r["index"] == {w: [i for i, x in enumerate(r.words) if x == w] for w in r.words}
        assert r.text == " ".join(r.words)
