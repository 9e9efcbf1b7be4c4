"""Folds over event logs, and the sheet."""

import random
from datetime import datetime, timedelta

import pytest

from vendorlake.operators import search, shortlist
from vendorlake.operators.counters import active_filters, shortlist_counts

T0 = datetime(2024, 1, 1)
SHORT = "event_id long, ts timestamp, list_id string, run_id string, id int, op string, field string, value string"
SELECT = "event_id long, ts timestamp, session_id string, op string, grp string, value string"
LOGS = [
    (["save"], True, {}),
    (["save", "email=x"], True, {"email": "x"}),
    (["save", "email=x", "unsave"], False, {"email": "x"}),
    (["save", "email=x", "unsave", "save"], True, {}),
    (["email=x"], False, {"email": "x"}),
    (["email=x", "save"], True, {}),
    (["unsave"], False, {}),
    (["save", "email=x", "email=y", "role=z"], True, {"email": "y", "role": "z"}),
]


def short_rows():
    rows = []
    for key, (log, _, _) in enumerate(LOGS):
        for n, e in enumerate(log):
            op, _, value = e.partition("=")
            rows.append((key * 100 + n, T0 + timedelta(seconds=n), "l", "r", key, "set" if value else op, op if value else None, value or None))
    return rows


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_fold_in_any_order(spark, seed):
    rows = short_rows()
    if seed is not None:
        random.Random(seed).shuffle(rows)
    got = {r["id"]: r for r in shortlist.fold(spark.createDataFrame(rows, SHORT)).collect()}
    for key, (_, saved, fields) in enumerate(LOGS):
        assert got[key]["saved"] == saved
        assert {f: got[key][f] for f in shortlist.META} == shortlist.DEFAULTS | fields


SELECTIONS = {
    "VV": (["v:V", "v:V"], [], []),
    "VWV": (["v:V", "v:W", "v:V"], ["W"], []),
    "clear": (["v:V", "clear_verticals", "v:V"], ["V"], []),
    "order": (["v:V", "v:W", "v:V", "v:V"], ["W", "V"], []),
    "product": (["v:V", "t:g:a", "p:X"], ["V"], []),
    "all": (["v:V", "t:g:a", "o:VC-Backed", "clear_all"], [], []),
    "tags": (["t:g:a", "t:h:b", "t:g:c", "t:g:a"], [], [("g", "c"), ("h", "b")]),
    "group order": (["t:g:a", "t:h:b", "t:g:a", "t:g:c"], [], [("g", "c"), ("h", "b")]),
}


def test_selection(spark):
    rows = []
    for key, (log, _, _) in SELECTIONS.items():
        for n, e in enumerate(log):
            kind, *rest = e.split(":")
            op = {"v": "toggle_vertical", "t": "toggle_tag", "p": "set_product", "o": "set_attr"}.get(kind, kind)
            grp = rest[0] if kind == "t" else "ownership" if kind == "o" else None
            rows.append((len(rows), T0 + timedelta(seconds=n), key, op, grp, rest[-1] if rest else None))
    rows.append((999, T0, "chosen", "set_attr", "ownership", "VC-Backed"))
    got = {r["brief_id"]: r for r in shortlist.selection(spark.createDataFrame(rows, SELECT)).collect()}
    for key, (_, verticals, tags) in SELECTIONS.items():
        assert got[key]["verticals"] == verticals, key
        assert [(t["grp"], t["tag"]) for t in got[key]["tags"]] == tags, key
        assert got[key]["ownership"] == "Any Ownership"
    assert got["chosen"]["ownership"] == "VC-Backed" and got["product"]["product"] == "X"


BRIEF = "brief_id string, product string, tags array<struct<grp:string,tag:string>>, verticals array<string>, ownership string, revenue string, size string, founded string"
ANY = tuple(search.SENTINELS.values())


def test_active_filters(spark):
    brief = spark.createDataFrame([("b", "P", [("g", "a"), ("g", "b")], ["V"], "VC-Backed", *ANY[1:])], BRIEF)
    assert active_filters(brief).first()["n_filters"] == 4
    chips = search.brief_chips(brief).first()["chips"]
    assert chips == ["P", "V", "a", "b", "VC-Backed"]
    assert search.brief_text(brief).first()["brief"] == "P; V; a, b; VC-Backed; any revenue; any size; any era"


COMPANY = (
    "run_id string, id int, name string, website string, country string, founded_year int, employees string, revenue string, ownership string, hq string, "
    "verticals array<string>, products array<string>, tags array<string>, description string, score double"
)


def company(**k):
    base = dict(run_id="r", id=1, name="Acme", website="https://a.example", country=None, founded_year=None, employees=None, revenue=None, ownership=None, hq=None, verticals=["X", "Y"], products=["P"], tags=[], description=None, score=1.0)
    return tuple((base | k).values())


@pytest.mark.parametrize(("quality", "website", "want"), [("Gold", None, ("https://a.example", "Gold")), ("—", None, ("https://a.example", "")), ("Gold", "https://b.example", ("https://b.example", "Gold"))])
def test_sheet(spark, tmp_path, quality, website, want):
    events = [(1, T0, "l", "r", 1, "save", None, None), (2, T0 + timedelta(1), "l", "r", 1, "set", "quality", quality), (3, T0 + timedelta(1), "l", "r", 1, "set", "email", "e@a.example")]
    if website:
        events.append((4, T0 + timedelta(1), "l", "r", 1, "set", "website", website))
    state = shortlist.fold(spark.createDataFrame(events, SHORT))
    rows = shortlist.sheet(shortlist.saved_companies(spark.createDataFrame([company()], COMPANY), state))
    r = rows.first().asDict()
    assert (r["Website"], r["Quality"], r["Vertical"], r["Country"], r["Year Founded"], r["Email"]) == (*want, "X, Y", "", "", "e@a.example")
    assert shortlist.write_sheet(rows, str(tmp_path / "out")) and not shortlist.write_sheet(rows.where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_counts_and_flags(spark):
    events = [(i, T0, "l", "r", i, "save", None, None) for i in (1, 2)]
    state = shortlist.fold(spark.createDataFrame(events, SHORT))
    companies = spark.createDataFrame([company(), company(id=5)], COMPANY)
    assert shortlist_counts(state, companies).first()[1:] == (2, 1, "2 companies")
    assert {r["id"]: r["is_saved"] for r in shortlist.saved_flags(companies, state).collect()} == {1: True, 5: False}
