"""Problems of the data: against brute force, and with what may be wrong with rows."""

import json
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions.keys import integer_key
from weftgraph.functions.text import plain_form
from weftgraph.operators import drift, duplicates, frequency, hierarchy, nested, orphans, weighted


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_plain_form_and_integer_keys(spark):
    texts = [None, "", " ", "CHEBI:10", "chebi：10", "GO:010", "GO:10", "\u212a1", "x" * 5000 + "7", "9" * 40, "ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", plain_form("t"))
    space, n = integer_key(F.col("p"))
    got = {r["i"]: r for r in df.withColumns({"s": space, "n": n}).collect()}
    assert [got[i]["p"] for i in range(8)] == ["", "", "", "chebi10", "chebi10", "go010", "go10", "1"]
    keys = {(r["s"], r["n"]) for r in got.values()}
    assert len(keys) == len({r["p"] for r in got.values()}) and got[9]["n"] == int("9" * 18)


# 1 -------------------------------------------------------------------------------


def _orphans(refs, parents):
    out = []
    for i, f, k, t in refs:
        lives = [(s, e) for key, s, e in parents if key == k]
        if not k:
            continue
        if any(s is not None and t is not None and s <= t and (e is None or t < e) for s, e in lives):
            continue
        late = lives and t is not None and all(s is not None and s > t for s, _ in lives)
        out.append((i, f, t, "missing" if not lives else "late" if late else "deleted"))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_orphans_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["", "a7", "a8", "a9", "a11", "a012", "b7", "hot1", "x"])
    refs = [(i, rnd.choice(["subject", "object"]), "hot1" if rnd.random() < 0.4 else key(), rnd.choice([None, *range(0, 50, 3)])) for i in range(400)]
    parents = [(key(), rnd.choice([None, *range(0, 50, 2)]), rnd.choice([None, *range(0, 60)])) for _ in range(rnd.choice([0, 6, 25]))]
    r = spark.createDataFrame(refs, "ref_id long, field_name string, key string, at long").withColumn("extra", F.lit(1))
    p = spark.createDataFrame(parents, "key string, start long, end long").withColumn("at", F.lit(1))
    assert rows(orphans.find_orphans(r, p)) == _orphans(refs, parents)


def test_orphans_of_empty_tables(spark):
    r = spark.createDataFrame([], "ref_id long, field_name string, key string, at long")
    p = spark.createDataFrame([], "key string, start long, end long")
    assert orphans.find_orphans(r, p).count() == 0


def test_key_runs(spark):
    keys = spark.createDataFrame([("s", n) for n in (1, 2, 3, 7, 65535, 65536)], "space string, n long")
    assert rows(orphans.key_runs(keys).select("lo", "hi")) == [(1, 3), (65535, 65535), (65536, 65536), (7, 7)]


@pytest.mark.parametrize("seed", range(2))
def test_references_of_one_key_over_many_ranges(spark, seed):
    """Ranges and batches smaller than a key's references: what a range begins with comes from those before."""
    rnd = random.Random(seed)
    keys = ["hot5", "hot6", "hot9", "a1", "z3"]
    refs = [(i, "subject", rnd.choice(["hot5", "hot5", "hot6", *keys]), rnd.choice([7, None, *range(0, 60, 4)])) for i in range(900)]
    parents = [("hot5", 3, 11), ("hot5", 20, 23), ("hot5", 4, 9), ("hot6", 30, None), ("a1", None, 5), ("hot7", 0, None)] + [("hot5", 1, s) for s in range(2, 40)] * seed
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(was, ("23", "false", "7")):
        spark.conf.set(k, v)
    try:
        got = rows(orphans.find_orphans(spark.createDataFrame(refs, "ref_id long, field_name string, key string, at long"), spark.createDataFrame(parents, "key string, start long, end long")))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == _orphans(refs, parents)


# 2 -------------------------------------------------------------------------------


def _forest(parent):
    nodes = set(parent) | set(parent.values())
    up = lambda n: [n, *_walk(parent, n)]
    out, below = {}, Counter()
    for n in nodes:
        for a in set(_walk(parent, n)) - {n}:
            below[a] += 1
    for n in nodes:
        way = _walk(parent, n)
        if n in way:
            out[n] = ("", -1, "cycle")
        elif way and way[-1] in _walk(parent, way[-1]):
            out[n] = ("", -1, "below_cycle")
        else:
            out[n] = (up(n)[-1], len(way), "ok")
    return sorted((n, r, d, below[n], s) for n, (r, d, s) in out.items())


def _walk(parent, n):
    seen, x = [], n
    while x in parent and parent[x] not in seen:
        x = parent[x]
        seen.append(x)
    return seen


@pytest.mark.parametrize("seed", range(5))
def test_hierarchies_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    parent = {f"n{i}": f"n{max(0, i - rnd.choice([1, 1, 1, 2, 9]))}" if rnd.random() < 0.95 else f"n{rnd.randrange(60)}" for i in range(1, 60)}
    parent |= {"c1": "c2", "c2": "c3", "c3": "c1", "self": "self", "under": "c1", "under2": "under", "d1": "d2", "d2": "d1"}
    links = [*parent.items(), *list(parent.items())[:5], (None, "x"), ("x", ""), ("", "y")]
    df = spark.createDataFrame(links, "child string, parent string").withColumn("node", F.lit("clash"))
    t = hierarchy.hierarchy(df)
    assert rows(t.select("node", "root", "depth", "n_desc", "state")) == _forest(parent)
    for r in t.filter("state = 'ok'").collect():
        assert r["path"] == [r["node"], *_walk(parent, r["node"])][::-1]
    d = Counter(r["node"] for r in hierarchy.descendants(t).collect())
    assert all(d[n] == k for n, _, _, k, s in _forest(parent) if s == "ok")


def test_descendants_in_every_state(spark):
    parent = {f"b{i}": f"b{(i + 1) % 7}" for i in range(7)} | {"h1": "b3", "h2": "h1", "h3": "h2", "h4": "h2", "c": "d", "d": "c", "self": "self", "under": "self", "r1": "r", "r2": "r1"}
    parent |= {f"t{i}": f"t{i + 1}" for i in range(9)} | {"t9": "d"}
    links = spark.createDataFrame([*parent.items(), ("h1", "b3"), (None, "x"), ("x", "")], "child string, parent string")
    t = hierarchy.hierarchy(links)
    expected = sorted((a, n, _walk(parent, n).index(a) + 1) for n in parent for a in set(_walk(parent, n)) - {n})
    got = rows(hierarchy.descendants(t, links))
    assert sorted(got) == expected
    n = Counter(a for a, _, _ in got)
    assert all(n[r["node"]] == r["n_desc"] for r in t.collect())


def test_long_chains_and_large_cycles_take_few_rounds(spark, monkeypatch):
    """A round takes a share of the nodes away, also of chains and of cycles."""
    parent = {f"a{i}": f"a{i + 1}" for i in range(400)} | {f"b{i}": f"b{(i + 1) % 70}" for i in range(70)} | {f"h{i}": f"b{i}" for i in range(3)} | {"h9": "h0", "t": "a150"}
    seen = []
    real = hierarchy._round
    monkeypatch.setattr(hierarchy, "_round", lambda *a: seen.append(1) or real(*a))
    t = hierarchy.hierarchy(spark.createDataFrame(list(parent.items()), "child string, parent string"))
    assert rows(t.select("node", "root", "depth", "n_desc", "state")) == _forest(parent) and len(seen) < 30
    assert t.filter("node = 'a0'").first()["path"] == [f"a{i}" for i in range(400, -1, -1)]


def test_hierarchy_of_nothing(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "child string, parent string")).count() == 0


# 3 -------------------------------------------------------------------------------


def test_nested_records_as_tables(spark, tmp_path):
    ddl = "id long, s array<struct<a:string,l:array<string>,deep:struct<x:int>,m:array<struct<z:double>>>>, tag string"
    data = [(1, [("p", ["u", None, "v"], (5,), [(0.5,)]), None, (None, [], None, None)], "t"), (2, None, None), (3, [], "x" * 9000)]
    df = spark.createDataFrame(data, ddl)
    scalars, levels = nested.levels_of(df.drop("id").schema)
    t = nested.emit_tagged(df, "id", levels, ("record", {k: F.col(k) for k in scalars}))
    nested.write_tagged(t, str(tmp_path / "t"))
    read = lambda tag, schema: sorted((tuple(r["pk"]), tuple(r["parent_pk"]), *r[2:]) for r in nested.read_tagged(spark, str(tmp_path / "t"), tag, schema).collect())
    assert read("s", {"a": "string", "deep.x": "int"}) == [((1, 0), (1,), "p", 5), ((1, 2), (1,), None, None)]
    assert read("s.l", {"value": "string"}) == [((1, 0, 0), (1, 0), "u"), ((1, 0, 2), (1, 0), "v")]
    assert read("s.m", {"z": "double"}) == [((1, 0, 0), (1, 0), 0.5)]
    assert [r[0] for r in read("record", {"tag": "string"})] == [(1,), (2,), (3,)]
    assert nested.emit_tagged(df.limit(0), "id", levels).count() == 0


def test_tagged_tables_without_rows_are_read(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id long, s array<struct<a:string>>")
    nested.write_tagged(nested.emit_tagged(df, "id", nested.levels_of(df.drop("id").schema)[1]), str(tmp_path / "t"))
    assert nested.read_tagged(spark, str(tmp_path / "t"), "s", {"a": "string"}).collect() == []


# 4 -------------------------------------------------------------------------------


@pytest.mark.parametrize("batch", [3, 10_000])
def test_term_counts(spark, batch):
    rnd = random.Random(5)
    pairs = [(rnd.choice("ab"), rnd.choice([None, "", "x", "x", "x", "y", "z", "long" * 2000]), rnd.randrange(40), 1 + rnd.randrange(2)) for _ in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rows(frequency.term_frequencies(spark.createDataFrame(pairs, "field_name string, term string, record long, times long").withColumn("n_occur", F.lit(0))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, recs = Counter(), defaultdict(set)
    for f, t, r, k in pairs:
        if t:
            n[f, t] += k
            recs[f, t].add(r)
    assert got == sorted(((f, t, n[f, t], len(recs[f, t])) for f, t in n), key=str)
    assert frequency.term_frequencies(spark.createDataFrame([], "field_name string, term string, record long, times long")).count() == 0


def test_marks(spark):
    f = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("a", "z", 4), ("b", "w", 4)], "field_name string, term string, n_records long")
    assert [r["mark"] for r in frequency.with_mark(f, {"a": 10, "b": 100}).orderBy("term").collect()] == ["ok", "rare", "ok", "common"]


# 5 -------------------------------------------------------------------------------


@pytest.mark.parametrize("bins", [2, 256])
def test_weighted_results(spark, bins):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}", rnd.choice([None, *[float(x) for x in range(12)]])) for _ in range(600)] + [("nulls", None)]
    w = weighted.compress(spark.createDataFrame(data, "k string, v double").withColumn("value", F.lit("clash")), ["k"], "v")
    by = defaultdict(list)
    for k, v in data:
        by[k].append(v)
    real = {k: sorted(x for x in v if x is not None) for k, v in by.items()}
    assert rows(weighted.counts(w, ["k"])) == sorted((k, len(v), len(set(real[k]))) for k, v in by.items())
    mode = {k: min(Counter(v).items(), key=lambda x: (-x[1], x[0])) for k, v in real.items() if v}
    assert rows(weighted.modes(w, ["k"])) == sorted((k, *m) for k, m in mode.items())
    for q in (0.0, 0.5, 0.9, 1.0):
        want = sorted((k, v[max(0, -int(-len(v) * q // 1) - 1)]) for k, v in real.items() if v)
        assert rows(weighted.percentiles(w, ["k"], q, bins)) == want
    assert weighted.percentiles(w.limit(0), ["k"], 0.5).count() == 0


# 6 -------------------------------------------------------------------------------


def _file(feed, no, records, fid=None):
    return [(no * 100 + i, feed, fid or f"{feed}-{no}", no, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]


LINES = "line_id long, feed string, file_id string, file_no int, payload string"


def test_schema_changes(spark):
    base = [{"a": i, "b": f"v{i}", "s": [{"x": f"x{i}", "y": 1}], "gone": True, "n": None} for i in range(4)]
    later = [{"a": str(i), "bb": f"v{i}", "s": [{"xx": f"x{i}", "y": 1}], "n": 1, "new": 2.0} for i in range(4)]
    wide = [{"a": "1", "bb": "other", "s": {"xx": "x1", "z": 2}, "n": None}]
    lines = _file("f", 2, [*later, "{bad", None, "[1]", '{"a": NaN}']) + _file("f", 1, base + base) + _file("f", 3, wide) + _file("g", 1, base) + _file("f", 2, later)
    got = rows(drift.changes(spark.createDataFrame(lines, LINES).withColumn("path", F.lit(1))).select("file_id", "change_kind", "old_path", "new_path"))
    assert got == [
        ("f-2", "added", "", "new"), ("f-2", "removed", "gone", ""), ("f-2", "renamed", "b", "bb"), ("f-2", "renamed", "s.x", "s.xx"), ("f-2", "type_changed", "a", "a"),
        ("f-3", "removed", "new", ""), ("f-3", "type_changed", "s", "s"),
    ]
    assert drift.changes(spark.createDataFrame([], LINES)).count() == 0


def test_unified_files(spark):
    lines = _file("f", 1, [{"b": "v1", "c": "x"}, {"b": "v2", "c": ["x", "y"]}]) + _file("f", 2, [{"bb": "v1", "c": '["q"]', "w": "1.5"}, "{"]) + _file("f", 3, [{"bbb": "v1", "w": 2}])
    df = spark.createDataFrame(lines, LINES)
    t = drift.unify(df, drift.canonical_names(drift.changes(df)), {"b": "string", "c": ["string"], "w": "number"}, "b string, c array<string>, w double")
    assert [(r["b"], r["c"], r["w"]) for r in t.orderBy("line_id").collect()] == [("v1", ["x"], None), ("v2", ["x", "y"], None), ("v1", ["q"], 1.5), ("v1", None, 2.0)]


def test_unified_files_keep_every_value(spark):
    one = [
        {"b": "v1", "note": "n", "c": ["x"], "w": 1, "none": None, "k": 2}, {"b": "v2", "c": {"id": "x", "label": "l"}, "w": "many", "d": [{"x": "u", "z": 5}]},
        {"b": ["p", "q"], "w": [1, 2], "d": ["bare"]}, {"w": True, "b": []}, {"w": 2**60 + 1, "b": None}, {"w": "9007199254740993"}, {"w": "7"}, {"w": 10**400},
    ]
    two = [{"b": "new", "bb": "v1", "k": 3}, {"b": "new", "bb": "v2", "a.w": 1}, {"bb": '["p", "q"]'}]
    df = spark.createDataFrame(_file("f", 1, one) + _file("f", 2, two), LINES)
    names = spark.createDataFrame([("f", 2, 2**31 - 1, "bb", "b"), ("f", 2, 2**31 - 1, "k", "kk")], "feed string, from_no int, to_no int, path string, name string")
    target = {"b": "string", "c": ["string"], "w": "number", "d": [{"x": "string"}]}
    t = drift.unify(df, names, target, "b string, c array<string>, w double, d array<struct<x:string>>").orderBy("line_id").collect()
    assert [r["rest"] and {k: json.loads(v) for k, v in r["rest"].items()} for r in t] == [
        {"note": "n", "k": 2}, {"c": {"id": "x", "label": "l"}, "w": "many", "d": [{"x": "u", "z": 5}]}, {"w": [1, 2], "d": ["bare"]}, {"w": True, "b": []}, {"w": 2**60 + 1},
        {"w": "9007199254740993"}, None, {"w": 10**400}, {"b#": "new", "kk": 3}, {"b#": "new", "a.w": 1}, None,
    ]
    assert [r["b"] for r in t][-3:] == ["v1", "v2", '["p", "q"]'] and t[1]["c"] == ["x"] and t[6]["w"] == 7.0


def test_values_and_flooding():
    assert drift.value_hash({"a": 1, "b": [1.0]}) == drift.value_hash({"b": [1], "a": 1.0}) != drift.value_hash({"b": [2], "a": 1})
    old, new = {"p": 8, "p.a": 1, "p.k": 1}, {"p": 8, "p.z": 1, "p.k": 1}
    s = drift.flood(old, new, {("p", "p"): 1.0, ("p.k", "p.k"): 1.0, ("p.a", "p.z"): 0.7})
    assert 0 < s["p.a", "p.z"] < 1 and max(s.values()) <= 1.0
    assert [drift.fit(x, "number") for x in ("2", "x", [3], {"id": 4}, None)] == [2.0, None, 3.0, 4.0, None]
    assert drift.parse_object("[]") is None and drift.parse_object(None) is None and drift.parse_object('{"a": 1, "a": 2}') == {"a": 2}


# 7 -------------------------------------------------------------------------------

COLS = "id long, s string, p string, o string, q string, c0 int"


def test_hidden_duplicates(spark):
    data = [
        (5, "A:1", "treats", "B:2", None), (3, "a 1", "Treats", "b2", ""), (9, "A:1", "treats", "B:2", None), (4, "A:1", "treats", "B:2", "x_y"), (7, "A1", "treats", "b:2", "X Y "),
        (10, "A:1", "treats", "B:2", '{"k": "v", "j": "w"}'), (11, "A:1", "treats", "B:2", '{"J":"W ","k":"v"}'), (12, "A:1", "treats", "B:2", '["v", "w"]'), (13, "A:1", "treats", "B:2", '["w", "v"]'),
        (14, None, "treats", "B:2", None), (15, None, "treats", "B:2", None), (16, " ", "x", "y", None), (17, "L" * 20000, "p", "o", "{broken"), (18, "l" * 20000, "P", "o", "broken"),
    ]
    df = spark.createDataFrame([(*d, 1) for d in data], COLS)
    assert rows(duplicates.copies(df, "id", ["s", "p", "o"], ["q"])) == sorted([(3, 5), (3, 9), (4, 7), (10, 11), (17, 18)], key=str)
    s, _ = duplicates.collapse(df, "id", ["s", "p", "o"], ["q"])
    assert rows(s.select("first_row", "n_copies")) == sorted([(3, 3), (4, 2), (10, 2), (12, 1), (13, 1), (17, 2)], key=str)
    assert duplicates.copies(df.limit(0), "id", ["s", "p", "o"], ["q"]).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "A", "a-", "b", None]), st.sampled_from(["", None, "q", "Q", '{"a":1,"b":2}', '{"b":2,"a":1}', "a1b2"])), max_size=40))
def test_copies_are_one_less_than_rows(spark, data):
    df = spark.createDataFrame([(i, a, "p", "o", q, 0) for i, (a, q) in enumerate(data)], COLS)
    s, _ = duplicates.collapse(df, "id", ["s", "p", "o"], ["q"])
    n = s.agg(F.coalesce(F.sum("n_copies"), F.lit(0)), F.count("*")).first()
    assert n[0] == sum(a is not None for a, _ in data) and duplicates.copies(df, "id", ["s", "p", "o"], ["q"]).count() == n[0] - n[1]
