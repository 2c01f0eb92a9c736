"""Edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from paperweave.constants import LEGACY_CODES, STOP_WORDS
from paperweave.functions import labels as L
from paperweave.functions import similarity, text
from paperweave.operators import corpus, nested
from paperweave.operators.matching import author_score


def one(spark, column, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        (None, ""),
        ("", ""),
        ("<jats:p>Abstract A\nB</jats:p>", "AB"),
        ("abstraction", "ion"),
        ("  x ", "x"),
        ("ABSTRACT: y\r\n\tz", ": yz"),
    ],
)
def test_clean_abstract(spark, given, expected):
    assert one(spark, text.clean_abstract(F.col("v")), given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("The state-of-the-art of 3 cats", ["the", "stateoftheart", "cat"]),
        ("", []),
        ("Studies of classes, boxes and x² glass", ["study", "class", "box", "x", "glass"]),
    ],
)
def test_tokens(spark, given, expected):
    assert one(spark, text.tokens("v"), given) == expected


def test_stop_words_are_the_usual_list():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 179


def test_terms(spark):
    df = spark.createDataFrame([(["a", "neural", "nets—deep"],), ([],), (["one"],)], "t array<string>")
    got = [r.r for r in df.select(text.terms("t").alias("r")).collect()]
    assert got == [["neural", "nets", "deep", "neural nets", "nets deep"], [], ["one"]]


def test_label_functions(spark):
    df = spark.createDataFrame([("cmp-lg cs.AI",)], "v string").withColumn("a", L.label_array(F.col("v")))
    mapped = L.map_lenient(F.col("a"), L.lookup(LEGACY_CODES))
    row = df.select(
        L.label_string(mapped).alias("m"),
        L.has_label(mapped, "cs.CL").alias("has"),
        L.has_label(mapped, "cs").alias("part"),
        L.drop_label(mapped, "cs.AI").alias("rest"),
    ).first()
    assert (row.m, row.has, row.part, row.rest) == ("cs.CL cs.AI", True, False, ["cs.CL"])


def test_map_strict_refuses_unknown(spark):
    df = spark.createDataFrame([(["a", "b"],)], "l array<string>")
    with pytest.raises(Exception, match="label without a mapping"):
        df.select(L.map_strict(F.col("l"), L.lookup({"a": "A"}))).collect()


def test_subjects_and_authors(spark):
    assert one(spark, text.normalise_subjects(F.col("v")), "(['Physics (all)', 'AI'],)") == ["Physics all", "AI", ""]
    assert one(spark, text.normalise_authors(F.col("v")), "['A. Smith', 'B. Lee et al',12]") == ["A Smith", "B Lee"]


def test_to_nolabel(spark):
    df = spark.createDataFrame([(["A"],), (["A", "C"],), (["A", "B"],)], "categories array<string>")
    got = [r.categories for r in corpus.to_nolabel(df, ["A", "B"]).collect()]
    assert got == [["nolabel"], ["C"], ["nolabel"]]


def test_flatten_nested(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":"x"},"c":["y",{"d":"z"}]}')], "id int, doc string")
    assert sorted(r.value for r in nested.flatten_nested(df, "id", "doc").collect()) == ["x", "z"]


def test_flatten_nested_depth_and_odd_text(spark):
    deep = '{"a":' * 20_000 + '"x"' + "}" * 20_000
    rows = [(1, deep), (2, '{"a": 1,}'), (3, None), (4, '{"a": 1.50, "b": [1, {"c": null}], "d": true, "e": "\\u00e9\\"", "f": {}, "g": []}'), (5, '{"a": 1} x'), (6, "[]"), (7, "{")]
    got = {}
    for r in nested.flatten_nested(spark.createDataFrame(rows, "id int, doc string"), "id", "doc").collect():
        got.setdefault(r.id, []).append((r.path if r.id > 1 else None, r.value))
    assert got == {1: [(None, "x")], 4: [("$/a", "1.5"), ("$/b/1/c", None), ("$/d", "true"), ("$/e", 'é"')]}


def test_flatten_nested_bad_escape_beside_good_rows(spark):
    digits, fraction = "7" * 5000, "0." + "123456789" * 5
    rows = [
        (1, r'{"a": "\q"}'), (2, '{"a": "x"}'), (3, r'{"a": "\u12g4"}'), (4, '{"a": "b\nc"}'), (5, r'{"\q": 1}'), (6, f'{{"a": {digits}}}'),
        (7, f'{{"a": {fraction}, "b": -0.50, "c": 100.0, "d": 1.5e400, "e": 100}}'), (8, r'{"a": "x\ud800y", "b": "\ud83d\ude00"}'), (9, '{"a": "x'),
    ]
    got = {}
    for r in nested.flatten_nested(spark.createDataFrame(rows, "id int, doc string"), "id", "doc").collect():
        got.setdefault(r.id, []).append(r.value)
    assert got == {2: ["x"], 6: [digits], 7: [fraction, "-0.5", "100", "1.5e400", "100"], 8: ["x?y", "\U0001f600"]}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_score_is_the_common_subsequence():
    words = ["", "a", "kitten", "sitting", "gene expression", "gen expresion", "ééà", "éa", "aaaa", "aaab"]
    for a in words:
        for b in words:
            expected = 100 if a == b else round(200 * lcs(a, b) / (len(a) + len(b)))
            assert similarity.score(a, b) == expected, (a, b)


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("Physics", "physics", 100),
        ("small ring", "ring small", 95),
        ("Computer Science", "Computer Sciences", 97),
        ("Biology", "Marine Biology and Ecology", 90),
        ("", "x", 0),
    ],
)
def test_weighted_score(a, b, expected):
    assert similarity.weighted_score(a, b) == expected


def test_at_least_agrees_with_ratio(spark):
    base = "on the spectral theory of random graphs"
    others = [base, base[:-1], base[1:-2], base.replace("random", "rendom"), base.upper(), "", base[::-1], base + "!!", None]
    pairs = [(x, y) for x in others for y in others]
    df = spark.createDataFrame(pairs, "a string, b string")
    for least in (60, 85, 96):
        got = df.select("a", "b", similarity.at_least(F.col("a"), F.col("b"), least).alias("r")).collect()
        for r in got:
            expected = r.a is not None and r.b is not None and similarity.score(r.a, r.b) >= least
            assert r.r == expected, (r, least)


def test_author_score(spark):
    rows = [
        (["J. Smith"], "['John Smith', 'Ann Lee']", 0),
        (["Ann Lee"], "['John Smith', 'Ann Lee']", 1),
        (["Katharina Z Petersen"], "['K. Petersen']", 1),
        (["Petersen, Kath"], "['Petersen Kat']", 1),
        ([], "['A B']", 0),
        (["12"], "12", 0),
    ]
    df = spark.createDataFrame(rows, "found array<string>, own string, expected int")
    for r in df.withColumn("got", author_score(F.col("found"), F.col("own"))).collect():
        assert r.got == r.expected, r
