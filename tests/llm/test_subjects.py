import os

import pytest

from weftgraph.llm import subjects
from weftgraph.llm.posts import own_text

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    ("text", "own"),
    [
        (None, None), ("", None), (" \n", None), ("[deleted]", None), ("<p>[deleted]</p>", None), ("[removed by moderator]", None),
        ("> q\nmine\n>> r", "mine"), ("On day 3, x wrote:\n> q\nmine\n-- \nsig", "mine"), ("[quote=a]q[/quote] mine", "mine"), ("[quote=a][quote=b]q[/quote]r[/quote]mine", "mine"),
        ("[quote=a][quote=b]cut[/quote]\nmine", "mine"), ("[quote=a]On day 1, b wrote:\n> cut[/quote]\nmine", "mine"), ("> [quote=a]cut\nmine", "mine"), ("> only", ""),
        ("a<br>b &#39;c&#39; [i]d[/i]", "a\nb 'c' d"), ("[quote=never closed mine", "[quote=never closed mine"), ("[quote=a]x[/quote]m1 [quote=b]y[/quote]m2", "m1 \nm2"),
    ],
)
def test_own_text(text, own):
    got = own_text(text)
    assert got is own is None or got.strip() == own


def test_held_out_labels(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/area_labels.parquet")
    held = labels.filter("pmod(xxhash64(doc_id, 7), 2) = 1")
    got = subjects.assign_subjects(docs, labels.join(held, "doc_id", "left_anti")).join(held.select("doc_id").distinct(), "doc_id")
    a, b = {tuple(r) for r in got.select("doc_id", "area").collect()}, {tuple(r) for r in held.collect()}
    assert len(a & b) / len(a) > 0.94 and len(a & b) / len(b) > 0.94


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "> q", 0), (4, "thanks all", 0), (5, "thanks all", 0), (6, "the verdict of the court " * 5000, 0)], "doc_id long, text string, area int")
    labels = spark.createDataFrame([(4, "everyday"), (4, "everyday"), (5, None), (99, "law")], "doc_id long, area string")
    assert sorted(map(tuple, subjects.assign_subjects(docs, labels).filter("doc_id < 6").collect())) == [(4, "everyday"), (5, "everyday")]
    none = labels.limit(0)
    assert {r["doc_id"] for r in subjects.assign_subjects(docs, none).collect()} == {4, 5, 6}
    assert subjects.assign_subjects(docs.limit(0), none).count() == 0
