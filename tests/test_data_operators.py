"""Hierarchies, flattening, references, snapshots, components: against small expected results and brute force."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.operators import hierarchy as H
from auditloom.operators import nested as N
from auditloom.operators import references as R
from auditloom.operators import snapshots as S
from auditloom.operators.components import connected_components
from tests.helpers import NOW, pages

DEFS = "row_id long, registry string, name string, parent string, loaded_at timestamp, extra string"


def defs(spark, *rows):
    return spark.createDataFrame([(i, *r[:3], NOW + datetime.timedelta(hours=r[3] if len(r) > 3 else 0), "x") for i, r in enumerate(rows)], DEFS)


def test_hierarchy_paths_roots_cycles(spark):
    df = defs(
        spark, ("a", "root", None), ("a", "mid", " root "), ("a", "leaf", "mid"), ("a", "odd", "nowhere"), ("a", "x", "y"), ("a", "y", "x"), ("a", "below", "x"), ("a", "deeper", "below"),
        ("a", "self", "self"), ("b", "mid", "root"), ("a", "case", "ROOT"), ("a", "moved", "root", 0), ("a", "moved", "mid", 5), ("a", "blank", "  "), (None, "n", None), ("a", None, "root"),
    )
    got = {(r.tree, r.name): r for r in H.hierarchy(df).collect()}
    assert {k: v.path for k, v in got.items()} == {
        ("a", "root"): "root", ("a", "mid"): "root/mid", ("a", "leaf"): "root/mid/leaf", ("a", "odd"): "odd", ("a", "x"): "(cycle)", ("a", "y"): "(cycle)", ("a", "below"): "(cycle)",
        ("a", "deeper"): "(cycle)", ("a", "self"): "(cycle)", ("b", "mid"): "mid", ("a", "case"): "case", ("a", "moved"): "root/mid/moved", ("a", "blank"): "blank",
    }
    assert got[("a", "x")].status == "cycle" and got[("a", "below")].status == "below_cycle" and got[("a", "deeper")].status == "below_cycle"
    assert got[("a", "root")].size == 4 and got[("a", "leaf")].depth == 3 and got[("a", "leaf")].root == "root"
    d = {(r.ancestor, r.descendant, r.distance) for r in H.descendants(H.hierarchy(df)).collect()}
    assert d == {("root", "mid", 1), ("root", "leaf", 2), ("mid", "leaf", 1), ("root", "moved", 2), ("mid", "moved", 1)}


@pytest.mark.parametrize("tree_rows", [200_000, 140, 10])  # whole trees in tasks, the larger one in rounds, both in rounds
def test_hierarchy_random_against_walk(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(H, "TREE_ROWS", tree_rows)
    rnd = random.Random(3)
    rows = []
    for reg in "pq":
        for i in range(120):
            rows.append((reg, f"n{i}", f"n{rnd.randrange(-5, 130)}" if i and rnd.random() < 0.97 else None))
    rows += [("p", f"chain{i}", f"chain{i - 1}" if i else None) for i in range(25)]
    parent = {(r, n): p for r, n, p in rows}

    def path(r, n):
        seen, out = set(), []
        while True:
            if n in seen:
                return "(cycle)"
            seen.add(n)
            out.append(n)
            p = parent[(r, n)]
            if p is None or (r, p) not in parent:
                return "/".join(reversed(out))
            n = p

    got = {(r.tree, r.name): r.path for r in H.hierarchy(defs(spark, *rows)).collect()}
    assert got == {(r, n): path(r, n) for r, n, _ in rows}


def test_hierarchy_empty_and_star(spark):
    assert H.hierarchy(defs(spark).limit(0)).count() == 0
    star = [("s", "hub", None)] + [("s", f"l{i}", "hub") for i in range(500)]
    got = H.hierarchy(defs(spark, *star)).where("name = 'hub'").first()
    assert got.size == 501 and got.height == 1


CRAWLS = "crawl_id long, site string, received_at timestamp, payload string, kind string"


def crawls(spark, *rows):
    return spark.createDataFrame([(i, "s", NOW + datetime.timedelta(minutes=m), p if p is None or isinstance(p, str) else json.dumps(p), "clash") for i, m, p in rows], CRAWLS)


def test_flatten_shapes(spark):
    rec = {
        "pages": [None, {"url": "u", "links": ["a", None, "b"], "redirect_chain": "r", "headers": {"H": ["1", "2"], "I": "3", "J": None}}, {"links": None}, "text"],
        "issues": {"check_name": "c"}, "lighthouse": [{"url": "l", "performance_score": "12.5"}, {}],
    }
    got = {tuple(r) for r in N.flatten(crawls(spark, (1, 0, rec), (1, -5, {"issues": []}), (2, 0, {"result": rec, "pages": []}), (3, 0, '{"pages": ['), (4, 0, None), (5, 0, "[1]"), (6, 0, {"pages": {"url": 7}}))).select(
        "crawl_id", "kind", "pos", "sub", "item_key").collect()}
    one = {
        ("page", 1, -1, "u"), ("page", 2, -1, ""), ("link", 1, 0, "a"), ("link", 1, 2, "b"), ("redirect", 1, 0, "r"), ("header", 1, 0, "H"), ("header", 1, 1, "H"), ("header", 1, 0, "I"),
        ("issue", 0, -1, "c"), ("lighthouse", 0, -1, "l"), ("lighthouse", 1, -1, ""),
    }
    assert got == {(i, *x) for i in (1, 2) for x in one} | {(6, "page", 0, -1, "7")}


def test_flat_tables_round_trip(spark, tmp_path):
    e = N.flatten(crawls(spark, (1, 0, {"pages": [{"url": "u", "depth": "2", "status_code": "x", "links": ["a"]}], "lighthouse": {"url": "l", "performance_score": "12.5"}})))
    N.write_tables(e, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    p = N.flat_table(back, "page").first()
    assert (p.url, p.depth, p.status_code, p.parent_pk) == ("u", 2, None, "")
    assert N.flat_table(back, "lighthouse").first().performance_score == 12.5
    link = N.flat_table(back, "link").first()
    assert link.value == "a" and link.parent_pk == p.pk
    with pytest.raises(ValueError):
        N.flat_table(back, "nothing")


def test_flatten_empty_and_no_constants(spark):
    lone = '{"pages": {"url": "a\\ud800", "headers": {"h\\udfff": "v\\ud800"}}}'
    assert {r.item_key for r in N.flatten(crawls(spark, (1, 0, lone))).collect()} == {"a?", "h?"}
    assert N.flatten(crawls(spark).limit(0)).count() == 0
    assert list(N.visit('{"pages": [{"url": NaN}]}')) == []
    assert list(N.visit("[" * 100_000)) == []


def test_orphan_references_kinds(spark):
    h = datetime.timedelta(hours=1)
    p = pages(
        spark,
        {"seq": 1, "url": "https://example.com/a", "links": ["https://EXAMPLE.com/gone#x", "https://example.com/dead", "https://example.com/later", "https://example.com/soon", "https://other.com/q", "/rel", None,
                                                            "HTTPS://example.com/A", "https://example.com/gone#x", "https://u@example.com:443/z"]},
        {"seq": 2, "url": "https://example.com/dead", "status_code": 200},
        {"seq": 3, "url": "https://Example.com/dead#f", "status_code": 410, "fetched_at": NOW + h},
        {"seq": 4, "url": "https://example.com/later", "fetched_at": NOW + 25 * h},
        {"seq": 5, "url": "https://example.com/soon", "fetched_at": NOW + 24 * h},
        {"seq": 6, "url": None, "links": None},
        {"seq": 7, "url": "https://example.com/m", "links": ["https://example.com/later"], "fetched_at": NOW + 60 * 24 * h},
        {"seq": 8, "url": "https://example.com/n", "links": ["https://example.com/later", "https://example.com/gone"], "fetched_at": None},
    )
    got = {(r.seq, r.link, r.kind) for r in R.orphan_references(p).collect()}
    assert got == {
        (1, "https://EXAMPLE.com/gone#x", "missing"), (1, "https://example.com/gone#x", "missing"), (1, "https://example.com/dead", "deleted"), (1, "https://example.com/later", "late"), (1, "HTTPS://example.com/A", "missing"),
        (1, "https://u@example.com:443/z", "missing"), (8, "https://example.com/gone", "missing"),
    }
    assert R.orphan_references(p.limit(0)).count() == 0


@pytest.mark.parametrize("salt_rows, hot_keys", [(100_000, 100), (20, 100), (20, 0)])  # no hot key, hot keys broadcast, hot keys joined
def test_orphan_references_random(spark, monkeypatch, salt_rows, hot_keys):
    monkeypatch.setattr(R, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(R, "HOT_KEYS", hot_keys)
    rnd = random.Random(5)
    facts = []
    for i in range(300):
        facts.append({
            "url": f"https://example.com/{rnd.randrange(150)}", "status_code": rnd.choice([200, 200, 404]), "fetched_at": NOW + datetime.timedelta(hours=rnd.randrange(2000)),
            "links": [f"https://example.com/{rnd.choice([1, rnd.randrange(220)])}" for _ in range(5)],
        })
    p = pages(spark, *facts)
    by: dict = {}
    for s, f in enumerate(facts, 1):
        by.setdefault(f["url"], []).append((f["fetched_at"], s, f["status_code"]))
    want = set()
    for s, f in enumerate(facts, 1):
        for x in set(f["links"]):
            if x not in by:
                want.add((s, x, "missing"))
            elif max(by[x])[2] in (404, 410):
                want.add((s, x, "deleted"))
            elif min(by[x])[0] > f["fetched_at"] + datetime.timedelta(hours=24):
                want.add((s, x, "late"))
    assert {(r.seq, r.link, r.kind) for r in R.orphan_references(p).collect()} == want


def test_tables_are_written_once_for_the_same_files(spark, tmp_path):
    rows = [(1, "s", NOW, '{"pages": [{"url": "u", "links": ["a", null, "b"]}], "issues": [{"check_name": "c"}]}', "x")]
    at = str(tmp_path / "crawls.parquet")
    spark.createDataFrame(rows, CRAWLS).write.parquet(at)
    one = N.written_once(spark.read.parquet(at))
    assert N.written_once(spark.read.parquet(at)) is one and {r.kind for r in one.collect()} == {"page", "link", "issue"}
    assert [r.value for r in N.flat_table(one, "link").orderBy("sub").collect()] == ["a", "b"] and N.flat_table(one, "page").first().url == "u"
    spark.createDataFrame([(2, *rows[0][1:])], CRAWLS).write.mode("append").parquet(at)
    assert {r.crawl_id for r in N.written_once(spark.read.parquet(at)).collect()} == {1, 2}


SNAPS = "baseline_id long, site string, seed_url string, created_at timestamp, version string, n_issues long"
ROWS = "row_id long, baseline_id long, site string, seq long, check_name string, severity string, message string, url string, detail string, change string"


def test_snapshot_changes(spark):
    snaps = spark.createDataFrame([(3, "s", "u", NOW, None, None), (1, "s", "u", NOW + datetime.timedelta(days=1), None, None), (2, "s", "u", NOW + datetime.timedelta(days=2), None, 0), (9, "s", "v", NOW, None, 1)], SNAPS)
    raw = [
        (3, 0, "a", "w", "m", "x", None), (3, 1, "b", "w", "m", "x", None), (3, 2, "c", "w", "m", "x", "d"), (3, 2, "c", "w", "m", "x", "d"), (3, 3, "k", "w", "1", "x", None), (3, 4, "k", "w", "2", "x", None),
        (1, 0, "a", "w", "m", "x", ""), (1, 1, "c", "w", "m", "x", "e"), (1, 2, "n", "w", "m", None, None), (1, 3, "k", "w", "2", "x", None), (1, 4, "k", "w", "1", "x", None), (1, 5, "a", "w", "m", "x", None), (9, 0, "a", "w", "m", "x", None),
    ]
    rows = spark.createDataFrame([(i, b, "s", q, c, sv, m, u, d, "clash") for i, (b, q, c, sv, m, u, d) in enumerate(raw)], ROWS)
    got = {tuple(r) for r in S.issue_changes(snaps, rows).collect()}
    assert got == {
        (1, "a", "x", "changed"), (1, "b", "x", "removed"), (1, "c", "x", "changed"), (1, "n", None, "added"), (2, "a", "x", "removed"), (2, "c", "x", "removed"), (2, "n", None, "removed"), (2, "k", "x", "removed"),
    }
    assert S.issue_changes(snaps, rows.limit(0)).count() == 0
    assert S.issue_changes(snaps.limit(0), rows).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components_match_union_find(spark, pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_path_and_nulls(spark):
    e = [(i, i + 1) for i in range(40)] + [(None, 3), (77, 77)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[77] == 77
