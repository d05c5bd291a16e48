from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, hashing, languages, text

T = " ".join(f"Sentence number {i} describes the council vote on the transit plan and its funding sources." for i in range(40))


def col(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expression).collect()]


def test_content_hash(spark):
    a, b, empty, none, marks = col(spark, ["Hi,   There!", "hi there", "", None, "!?"], hashing.content_hash("v"))
    assert a == b and empty is None and none is None and marks is None
    assert col(spark, ["ﬁne café"], hashing.content_hash("v")) == col(spark, ["fine Café!"], hashing.content_hash("v"))


def test_golden_fingerprints(spark):
    near = T.replace("Sentence number 3 ", "Sentence no. 3 ") + " Update: more."
    texts = ["the quick brown fox jumps over the lazy dog", T, T + " Update: more.", near, "two words", None]
    got = [None if v is None else f"{v & (1 << 64) - 1:016x}" for v in col(spark, texts, hashing.simhash64("v"))]
    assert got == ["77b12fe87cf06675", "d353b63933cca067", "d353b63933cca067", "d3d3b63933cc8067", None, None]
    assert [h[:16] for h in col(spark, texts[:4], hashing.content_hash("v"))] == ["05c6e08f1d9fdafa", "f452b9d6b30a28a9", "42c37c9040226382", "e8411fd56a052cc1"]


def test_bands_and_hamming(spark):
    v = -0x1234567890ABCDEF
    u = v & (1 << 64) - 1
    got = col(spark, [v], hashing.bands("v"), "long")[0]
    assert [(b.band, b.value) for b in got] == [(i, u >> 16 * i & 0xFFFF) for i in range(4)]
    assert col(spark, [v], hashing.hamming("v", F.lit(v ^ 0b10110)), "long") == [3]
    keys = [{(k.band, k.value) for k in col(spark, [x], hashing.block_keys("v"), "long")[0]} for x in (v, v ^ (1 << 3) ^ (1 << 30) ^ -(1 << 63))]
    assert len(keys[0]) == 10 and keys[0] & keys[1]


def test_word_count(spark):
    assert col(spark, ["a b  c", " a ", "", None, "é ü\n"], text.word_count("v")) == [3, 1, 0, 0, 2]


def test_clean_text(spark):
    values = ["  a &amp; b c\n", "x <b>y</b>", "5 < 6", "", None, " "]
    assert col(spark, values, text.clean_text("v")) == ["a & b c", "x y", "5 < 6", None, None, None]
    assert col(spark, ["a  b\r\n\n\n\n\nc ", None, "  "], text.clean_body("v")) == ["a b\n\nc", None, None]


def test_lists(spark):
    words = [["a, b;a", " c|", "x" * 101]]
    assert col(spark, words, text.split_keywords("v"), "array<string>") == [["a", "b", "c"]]
    names = [["By Ann Lee and Bob Ray", "von Eva, Jo Kim", "http://x.org/a", "Q"]]
    assert col(spark, names, text.clean_authors("v"), "array<string>") == [["Ann Lee", "Bob Ray", "Eva", "Jo Kim"]]
    assert col(spark, ["a\n\n b \n"], text.paragraphs("v")) == [["a", "b"]]


def test_title_and_mail(spark):
    df = spark.createDataFrame([("Story | The Site", "The Site"), ("The Site", "The Site"), ("A - b", None), ("X: S+", "S+")], "t string, s string")
    assert [r[0] for r in df.select(text.strip_site_name("t", "s")).collect()] == ["Story", "The Site", "A - b", "X"]
    assert col(spark, ["a@b.c", "a b@c.d", "x"], text.is_email("v")) == [True, False, False]


def test_languages(spark):
    assert col(spark, ["en-US", "pt_BR", " German", "x", "", None, "1a"], languages.normalize_language("v")) == ["en", "pt", "de", None, None, None, None]
    samples = ["the cat is on the mat and it was in the house for a long time that day", "der Hund ist in dem Haus und die Katze ist auf dem Dach mit den Kindern", "court"]
    assert col(spark, samples, languages.detect_language("v")) == ["en", "de", None]


AS_OF = datetime(2024, 6, 1, tzinfo=UTC)
DATES = [
    ("2024-05-14T08:30:00Z", "2024-05-14 08:30"), ("Tue, 14 May 2024 08:30:00 GMT", "2024-05-14 08:30"), ("Tue, 14 May 2024 03:30:00 -0500", "2024-05-14 08:30"),
    ("2024-05-14", "2024-05-14 00:00"), ("1715675400", "2024-05-14 08:30"), ("1715675400000", "2024-05-14 08:30"), ("May 14, 2024", "2024-05-14 00:00"),
    ("1980-01-01", None), ("2030-01-01", None), ("", None), (None, None), ("no date", None),
]


def test_parse_date(spark):
    shown = F.date_format(dates.parse_date("v", F.lit(AS_OF)), "yyyy-MM-dd HH:mm")
    assert col(spark, [v for v, _ in DATES], shown) == [d for _, d in DATES]


def test_fuzzy_date(spark):
    values = ["posted on 14 May 2024 at 8:30", "2024-05-14 10:30+02:00", "x" * 200, None]
    assert col(spark, values, F.date_format(dates.fuzzy_date("v", AS_OF), "yyyy-MM-dd HH:mm")) == ["2024-05-14 08:30", "2024-05-14 08:30", None, None]


@pytest.mark.parametrize(("value", "want"), [(1715675400, 30), (1715675400000.0, 30), ("junk", None)])
def test_parse_loose(value, want):
    got = dates.parse_loose(value, AS_OF)
    assert (got and got.minute) == want


def test_few_texts_are_python_objects_at_a_time():
    import pyarrow as pa

    live, most = [0], [0]

    class Held(str):
        def __del__(self):
            live[0] -= 1

    def one(t):
        live[0] += 1
        most[0] = max(most[0], live[0])
        return Held(t + "!")

    got = text.in_parts(pa.array(["a", None, "b"] * 500), one, pa.string())
    assert got.to_pylist() == ["a!", None, "b!"] * 500 and text.in_parts(pa.array([], pa.string()), one, pa.string()).to_pylist() == []
    assert most[0] <= 2 * text.PART_ROWS
