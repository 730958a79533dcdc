import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom.operators.packed import explode_packed, parse_packed

NUMBERS = [184.0733, 255.2329, 7.5, 1200.0]


def values(text, alone=True):
    columns, pairs, flags = parse_packed(text, alone)
    return [[s[0] for s in c] for c in columns], pairs, flags


@pytest.mark.parametrize(
    "text",
    ["184.0733,255.2329,7.5,1200.0", "184.0733, 255.2329, 7.5, 1200.0", "184,0733;255,2329;7,5;1200,0", "[184.0733, 255.2329, 7.5, 1200.0]", "{184.0733;255.2329;7.5;1200.0}", "184.0733 | 255.2329 | 7.5 | 1200.0",
     "184.0733 255.2329  7.5 1200", "184.0733\t255.2329\t7.5\t1200", "184.0733\n255.2329\n7.5\n1200\n", '"184,0733","255,2329","7,5","1200,0"', "'184.0733';'255.2329';'7.5';'1200'", '"184.0733,255.2329,7.5,1200"', "1.840733e+02,2.552329e+02,7.5e0,1.2E3",
     "184.0733|255.2329, 7.5;1200.0", "184,0733 255,2329 7,5 1200,0", "[184.0733, 255.2329, 7.5, 1200.0", "184.0733,255.2329,7.5,1200,"],
)
def test_notations_of_a_list(text):
    got, pairs, _ = values(text, alone=False)
    assert not pairs and got == [NUMBERS], got


@pytest.mark.parametrize("text", ["[[1.5, 2.5], [3.5, 4.5]]", "1.5:2.5 3.5:4.5", "(1.5,2.5),(3.5,4.5)", "1.5 2.5; 3.5 4.5", "1.5\t2.5\n3.5\t4.5", "[(1.5, 2.5), (3.5, 4.5)]", "1.5 2.5\n3.5 4.5\n"])
def test_notations_of_pairs(text):
    got, pairs, _ = values(text)
    assert pairs and got == [[1.5, 3.5], [2.5, 4.5]], got


def test_gaps_keep_their_place():
    for text in ("1.5,,2.5,NaN,3.5", "1.5; ; 2.5; null; 3.5", "[1.5, NA, 2.5, -, 3.5]"):
        assert values(text)[0] == [[1.5, None, 2.5, None, 3.5]], text
    assert values(";1,5;2,5")[0] == [[None, 1.5, 2.5]]
    assert values(None)[0] == [[]] and values("  ")[0] == [[]] and values("[]")[0] == [[]]


def test_malformed_quotes_and_brackets_are_read_and_flagged():
    got, _, flags = values('"1.5,2.5,3.5')
    assert got == [[1.5, 2.5, 3.5]] and "unclosed_quote" in flags
    got, _, flags = values("[1.5, 2.5")
    assert got == [[1.5, 2.5]] and "unclosed_bracket" in flags
    columns, _, _ = parse_packed('1.5,"2.5,3.5')
    assert [s[0] for s in columns[0]] == [1.5, 2.5, 3.5] and "unclosed_quote" in columns[0][1][2]
    columns, _, _ = parse_packed("1.5,abc,2.5")
    assert [s[0] for s in columns[0]] == [1.5, None, 2.5] and "not_a_number" in columns[0][1][2]
    assert values("1e999,2.5")[0] == [[None, 2.5]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.decimals(0, 2000, places=3)), min_size=2, max_size=30).filter(lambda v: v[-1] is not None and any(x is not None for x in v)), st.sampled_from([",", ", ", ";", " | ", "\t"]), st.sampled_from(["{}", "[{}]", '"{}"']))
def test_round_trip(numbers, sep, frame):
    text = frame.format(sep.join("" if x is None else str(x) for x in numbers))
    if sep == "\t" and numbers[0] is None:
        return
    assert values(text, alone=False)[0] == [[None if x is None else float(x) for x in numbers]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.,;|[](){}\"' \t\n-eNa:", max_size=60))
def test_nothing_crashes(text):
    columns, _, _ = parse_packed(text)
    assert all(v is None or v == v for c in columns for v, _, _ in c)


def test_rows_with_clashing_columns_repeats_and_nulls(spark):
    rows = [(1, "1.5,2.5", "3,4", "x", 9), (1, "1.5,2.5", "3,4", "x", 9), (2, None, None, None, None), (3, "1.5:2.5", "", "y", 1), (4, "7", None, "y", 1)]
    df = spark.createDataFrame(rows, "raw_id bigint, mzs string, intensities string, field string, pos int")
    got = sorted((r["row_key"], r["field"], r["pos"], r["value"]) for r in explode_packed(df, "raw_id", "mzs", "intensities").collect())
    one = [(1, "intensities", 1, 3.0), (1, "intensities", 2, 4.0), (1, "mzs", 1, 1.5), (1, "mzs", 2, 2.5)]
    assert got == sorted(one * 2 + [(3, "mzs", 1, 1.5), (3, "intensities", 1, 2.5), (4, "mzs", 1, 7.0)])
    assert explode_packed(df.where("false"), "raw_id", "mzs", "intensities").count() == 0


def test_a_very_long_list():
    text = ",".join(f"{i}.5" for i in range(100_000))
    assert len(values(text)[0][0]) == 100_000
