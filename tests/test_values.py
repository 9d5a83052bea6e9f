"""Rules of typed comparison, each by values of its own, and the walk over trees."""

import pytest

from veritrail.functions.values import STRATEGIES, compare, date, number
from veritrail.operators.trees import Labeller, key_paths, leaves


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_nothing_equals_only_nothing(strategy):
    for g in (None, ""):
        for e in (None, ""):
            assert compare(g, e, strategy)
        assert not compare(g, "7 July 2001", strategy) and not compare("7 July 2001", g, strategy)


CASES = {
    "exact": {True: [("Oslo", "Oslo"), (7, "7"), ("7", 7), (7.5, "7.5"), (True, "true"), (False, "FALSE"), (None, "")], False: [("Oslo", "oslo"), (7, 8), (7, 7.25), (7, 7.0), (True, 1), (True, "yes"), (float("nan"), float("nan"))]},
    "case_insensitive": {True: [("\tOslo ", "OSLO"), (12, " 12")], False: [("Oslo", "Bergen")]},
    "fuzzy": {True: [("north-sea oil", "Oil (North Sea)"), ("!?", "..."), ("a b c d e f g", "G F E D C B A")], False: [("red green blue", "red green black"), ("red", "...")]},
    "number": {True: [(250, 252.5), ("$ 1,250", 1250), ("1_000", "1000"), (0, 0.009), ("3e2", 300), ("inf", "inf"), (" 12\t", "12")], False: [(250, 253), (0, 0.02), ("many", 3), (True, 1), ("nan", "nan"), ("12d", 12)]},
    "date": {True: [("9 May 1987", "1987-05-09"), ("May 9, 1987", "05/09/1987"), ("25/12/1999", "Dec 25, 1999"), ("2001-02-03T04:05:06Z", "2001-02-03T04:05:06.000Z"), ("2001", 2001), ("Autumn 1987", "AUTUMN 1987")], False: [("9 May 1987", "10 May 1987"), ("Autumn 1987", "Winter 1987"), ("Q1 2020", "Q2 2020")]},
    "url": {True: [("http://a.no/x/", "HTTPS://www.a.no/x"), ("[site](http://a.no)", "site")], False: [("http://a.no", "http://b.no"), ("http://a.no//", "http://a.no")]},
    "email": {True: [("mailto:Me@A.no", "me@a.no"), ("[me@a.no](mailto:me@a.no)", "ME@A.NO ")], False: [("me@a.no", "you@a.no")]},
    "auto": {True: [("$7,000", 7000), ("0.50", "0.5"), ("1 June 2010", "2010-06-01"), ("Yes", "yes")], False: [("0.50", "0.51"), ("H1 FY24", "H2 FY24"), ("2010-06-01", "2010-06-02")]},
}


@pytest.mark.parametrize(("strategy", "same", "pair"), [(s, same, p) for s, cases in CASES.items() for same, pairs in cases.items() for p in pairs])
def test_compare(strategy, same, pair):
    assert compare(*pair, strategy) is same


def test_limits_and_unknown_strategies():
    assert compare("a b c", "a x y", "fuzzy", fuzzy_threshold=0.2) and not compare("a b c", "a x y", "fuzzy", fuzzy_threshold=0.21)
    assert not compare(250, 252.5, "number", number_tolerance=0.0) and compare("250", 250.0, "auto", number_tolerance=0.0)
    with pytest.raises(ValueError):
        compare("a", "b", "telepathy")


def test_what_is_no_number_and_no_date():
    assert number(True) is None and number("") is None and number("1__0") is None and number([1]) is None
    assert date("45.42") is None and date("2001") is None and date("FY 2020 May 1") is None and date("no digits") is None


def verdicts(schema, g, e):
    return [(r["path_str"], r["error_type"]) for r in Labeller().label(schema, g, e)]


@pytest.mark.parametrize(
    ("g", "e", "want"),
    [
        ({}, None, ["match"]), (None, {}, []), ({}, "x", ["hallucination"]), ("x", {}, ["omission"]), ([], None, ["type_mismatch"]), ([], "x", ["type_mismatch"]), ("x", [], ["type_mismatch"]),
        ("x", [1], ["type_mismatch"]), (None, [1], ["hallucination"]), ([1], None, ["omission"]), ([], {"a": 1}, ["type_mismatch"]), ({}, [1], ["hallucination"]), ([1], {}, ["omission"]), ([], {}, ["match"]), ({}, [], ["match"]),
    ],
)
def test_container_cells(g, e, want):
    assert [v for _, v in verdicts({}, g, e)] == want


def test_arrays_and_any_of():
    crew = {"properties": {"crew": {"items": {"type": "object", "properties": {"rank": {"evaluation_config": "string_exact"}}}}}}
    assert verdicts(crew, {"crew": [{"rank": "mate"}, {"rank": "cook"}]}, {"crew": [{"rank": "mate"}]}) == [("crew.0.rank", "match"), ("crew.1.rank", "omission")]
    assert verdicts(crew, {"crew": [{"rank": "mate"}]}, {"crew": [{"rank": "mate"}, {"rank": "cook"}]})[1] == ("crew.1.rank", "hallucination")
    tags = {"properties": {"k": {"evaluation_config": "array_llm", "items": {"type": "string"}}}}
    for e, word in ((["sea", "Oil"], "match"), (["sea", "gas"], "value_mismatch"), ([], "omission")):
        assert verdicts(tags, {"k": ["oil", "SEA"]}, {"k": e}) == [("k", word)]
    either = {"properties": {"s": {"anyOf": [{"type": "array", "items": {"type": "string"}}, {"type": "null"}]}}}
    assert verdicts(either, {"s": ["x"]}, {"s": ["x"]}) == [("s", "match")]
    members = {"properties": {"m": {"x-match-mode": "set_membership", "items": {}}}}
    assert verdicts(members, {"m": ["a"]}, {"m": ["A", "z", ""]}) == [("m.0", "match"), ("m.1", "value_mismatch"), ("m.2", "omission")]


def test_leaves_and_keys():
    tree = {"a": [1, {"b": None}], "c": {}, "d": "x"}
    assert [(".".join(map(str, p)), v) for p, v in leaves(tree)] == [("a.0", 1), ("a.1.b", None), ("d", "x")]
    assert key_paths(tree) == {"a", "a[].b", "c", "d"}
