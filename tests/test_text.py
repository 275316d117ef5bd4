"""Text functions against plain-Python statements of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brindle import config as C
from brindle.functions import ids, text as T

#: A text, what it is on one line, and what it is with its paragraphs kept.
CASES = [
    ("", "", ""),
    ("Mon-\nday  and\tTuesday", "Monday and Tuesday", "Monday and Tuesday"),
    ("over-  \n   flow of 9-\n7 units", "overflow of 97 units", "overflow of 97 units"),
    ("ends in a dash-\n- or two", "ends in a dash- - or two", "ends in a dash-\n- or two"),
    ("first row \n second\trow", "first row second row", "first row\nsecond row"),
    ("top\n\n\n\n\nbottom", "top bottom", "top\n\nbottom"),
    ("upper  half\n \n\t\nlower\t\thalf\n", "upper half lower half", "upper half\n\nlower half"),
    ("ho\u00adtel \u00adlobby", "hotel lobby", "hotel lobby"),
    ("uno\r\ndos\rtres", "uno dos tres", "uno\ndos\ntres"),
    ("\u00a0wide\u00a0 gap\u2003here ", "wide gap here", "wide\u00a0 gap\u2003here"),
    ("сло-\nво и дело", "слово и дело", "слово и дело"),
]
SAMPLES = [c[0] for c in CASES] + ["K4\u0301 with K5", "m\u00b3 \u00be 44", "VWXYZ before 9", "VWXYZ before\n9", "C3D4E5 q", "\x1cp\x1dq\x1f", "TB-7, TB - 55 or TB8", "911-0042 305C9 J77 ZZ-1", "???? ,,,, !"]
# fixed values: the patterns that results depend on
TERMS = [r"\b\d{3}-\d{4}\b", r"\b[A-Z]{1,4}-\d+\b", r"\bTB\s*-?\s*\d+\b", r"\b\d{2,}[A-Z]\d{1,}\b", r"\b[JKP]\d{1,3}\b", r"\b(?=[A-Z0-9]{5,}\b)(?=.*[A-Z])(?=.*\d)[A-Z0-9]+\b"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    q = T.quality(F.col("t"), F.lit("text"))
    return df.select("t", T.normalize(F.col("t")).alias("n"), T.normalize_paragraphs(F.col("t")).alias("p"), T.tech_terms(F.col("t")).alias("terms"), T.word_count(F.col("t")).alias("w"), q.alias("q"), ids.content_hash(F.col("t")).alias("h")).collect()


def test_normalize(rows):
    got = {r["t"]: (r["n"], r["p"]) for r in rows}
    for text, line, paragraphs in CASES:
        assert got[text] == (line, paragraphs), repr(text)


def test_normalized_documents_stay_as_they_are(spark):
    """On generated texts: a second pass changes nothing on one line, and only white space and hyphens at line ends go."""
    r = random.Random(6)
    texts = ["".join(r.choice(["ab", "c", " ", "  ", "\t", "\n", "\n\n", "\n \n\n", "x-\n", "7", ".", "\u00ad", "\r\n"]) for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t")).alias("n"), T.normalize_paragraphs(F.col("t")).alias("p"))
    for r in df.select("*", T.normalize(F.col("n")).alias("nn")).collect():
        kept = [c for c in r["t"] if not c.isspace() and c not in "-\u00ad"]
        assert [c for c in r["n"] if c not in " -"] == kept and [c for c in r["p"] if c not in " \n-"] == kept
        assert "  " not in r["n"] and "\n" not in r["n"] and r["n"] == r["n"].strip() == r["nn"]
        assert "\n\n\n" not in r["p"] and all(x == x.strip() for x in r["p"].split("\n")) and r["p"].strip() == r["p"]


def test_terms_and_words(rows):
    for r in rows:
        assert r["terms"] == sum(len(re.findall(p, r["t"])) for p in TERMS), repr(r["t"])
        assert r["w"] == len(r["t"].split()), repr(r["t"])


def test_quality_examples(spark):
    df = spark.createDataFrame([("Panel 55D3, fuse K12 and lamp J8.", "text"), ("nothing here", "text"), ("unreadable ###", "text"), ("x y", "note")], "t string, k string")
    got = df.select(T.quality(F.col("t"), F.col("k"))["score"].alias("s"), T.quality(F.col("t"), F.col("k"))["reasons"].alias("r")).collect()
    assert [g["s"] for g in got] == [0.6, 0.3, 0.0, 0.5]
    assert got[0]["r"][0].startswith("tech_terms_found (+0.3)")
    assert got[1]["r"] == ["low_word_count (2)"]


def test_scalars(spark):
    df = spark.createDataFrame([("a" * 61,), ("x\ny",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.short_title(F.col("t"))).collect()] == ["a" * 57 + "...", "x y", "", None]
    assert [len(r[0]) for r in df.where("t is not null").select(T.slices(F.col("t"))).collect()] == [2, 1, 0]
    v = [r[0]["reason"] for r in spark.createDataFrame([(" ",), ("ok",), ("x" * 4001,), ("Да",)], "t string").select(T.valid_query(F.col("t"))).collect()]
    assert v == ["empty", None, "too_long", "language"]


def test_citations(spark):
    df = spark.createDataFrame([("none",), ("[S9]",), ("[S1][S2]",)], "t string")
    assert [r[0] for r in df.select(T.citations_hold(F.col("t"), F.array(F.lit("S1"), F.lit("S2")))).collect()] == [False, False, True]
    assert not df.select(T.citations_hold(F.lit("[S1]"), F.array().cast("array<string>"))).first()[0]


def test_wrap_table(spark):
    pages = ["", "<table></table>", "<html><head></head><body>x</body></html>", "<html><BODY class='a'>x</body></html>", "<html>x</html>"]
    out = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "t string").select(T.wrap_table(F.col("t"))).collect()]
    assert out[0] == "" and out[1].startswith("<!doctype html>") and out[2].index("<style") < out[2].index("</head>")
    assert out[3].index("<BODY class='a'>") < out[3].index("<style") and out[4].startswith("<style")
    again = spark.createDataFrame([(out[2],)], "t string").select(T.wrap_table(F.col("t"))).first()[0]
    assert again == out[2]


def test_point_id(spark):
    import uuid

    got = spark.createDataFrame([("asset:1",), ("asset:x",)], "t string").select("t", ids.point_id(F.col("t"))).collect()
    assert all(r[1] == str(uuid.uuid5(uuid.NAMESPACE_URL, r[0])) for r in got)


def test_settings(tmp_path):
    assert C.from_env(env={"BRINDLE_TOP_K": "7", "BRINDLE_ENFORCE_CITATIONS": "no"}).top_k == 7
    assert C.csv(" a, ,b ") == ["a", "b"]
    (tmp_path / "c.yaml").write_text("chunking: {size: 512, overlap: 0}\nquality: {min_score: 0.0}\n")
    s = C.from_yaml(str(tmp_path / "c.yaml"))
    assert (s.chunking.size, s.chunking.overlap, s.quality.min_score, s.retrieval.top_k) == (512, 0, 0.0, 50)
    with pytest.raises(FileNotFoundError):
        C.from_yaml(str(tmp_path / "none.yaml"))
