import os
import random

import pytest

from weftgraph.llm import leakage as L

ITEM = "Olselen the safe vifavi would debug its 12 repository units although 92 saen kernels had left the old request near Zelmifa in 5 kg of dust today"


def _brute(docs, items):
    grams = lambda t: {tuple(w) for ws in [[x.lower() for x in L.words_of(t or "")]] for w in zip(*[ws[i:] for i in range(L.WINDOW)])}
    return sorted((d, i) for d, t in docs for i, p in items if grams(t) & grams(p))


def _found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as words", "2 as h")
    i = spark.createDataFrame(items, "item_id long, passage string").selectExpr("*", "1 as doc_id")
    return sorted(map(tuple, L.find_leaks(d, "doc_id", "text", i, "item_id", "passage").collect()))


def test_words():
    assert L.words_of("a<b>c [quote=x]d&amp;e \u212a [not " + "x" * 70 + "]f") == ["a", "c", "d", "e", "not", "x" * 70, "f"]


def test_whole_partial_marked_and_shouted_copies(spark):
    cut = " ".join(ITEM.split()[:12])
    docs = [(1, ITEM), (2, cut), (3, " ".join(ITEM.split()[:11])), (4, cut.upper().replace(" ", ",<br>")), (5, None), (6, ""), (7, "> " + cut.replace("would", "\n> would")), (8, "x " * 30000 + cut), (9, cut), (9, cut)]
    got = _found(spark, docs, [(1, ITEM), (2, ITEM), (3, None), (4, "short"), (5, " ".join(ITEM.split()[3:]))])
    assert [(d, i) for d, i, v, _ in got if v] == sorted({(d, i) for d in (1, 2, 4, 7, 8, 9) for i in (1, 2)} | {(1, 5)})


def test_changed_slots_must_be_consistent(spark):
    item = "The boy Adam has 12 apples and gives Adam 12 more of the 30 that Berta has left over"
    changed = item.replace("Adam", "Karl").replace("12", "17").replace("30", "41").replace("Berta", "Dora")
    broken = item.replace("Adam", "Karl", 1).replace("12", "17").replace("30", "17")
    got = _found(spark, [(1, changed), (2, broken), (3, item)], [(1, item)])
    n = {d: (v, c) for d, _, v, c in got}
    assert n[1][0] == 0 and n[1][1] == 8 and n[3][0] > 0 and n.get(2, (0, 0))[1] < 8


@pytest.mark.parametrize("seed", range(3))
def test_verbatim_pairs_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)] + ["Name", "12", "kg"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 14, 30])))) for i in range(8)]
    docs = []
    for d in range(30):
        words = " ".join(rnd.choice(vocab) for _ in range(20)).split()
        src = rnd.choice(items)[1].split()
        at = rnd.randrange(max(1, len(src) - 12))
        words[5:5] = src[at : at + rnd.choice([11, 12, 13])]
        docs.append((d, " ".join(words)))
    assert [(d, i) for d, i, v, _ in _found(spark, docs, items) if v] == _brute(docs, items)


def _replaced(passage, known, lower):
    """The passage with other numbers, units and names, each always the same."""

    def other(w):
        t = L.template_of(w.lower(), known)
        if t == L.NUMBER:
            return str(int(w) + 7) if w.isdigit() else {"two": "nine", "three": "eight"}.get(w.lower(), "eleven")
        return "weeks" if t == L.UNIT else "Q" + w[::-1].lower() if t == L.NAME else w

    out = L.WORD.sub(lambda m: other(m.group()), passage)
    return out.lower() if lower else out


def test_recall_of_reparameterised_passages(spark):
    """Every item's passage with other values, in a post of its own, as written and in lower case."""
    path = "/root/testdata/sf0.1/eval_items.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    items = [(r["item_id"], r["passage"]) for r in spark.read.parquet(path).collect()]
    known = {}
    for _, p in items:
        for w in L.words_of(p or ""):
            known[w.lower()] = known.get(w.lower(), True) and w[:1].isupper()
    docs, wanted = [], set()
    for i, p in items:
        for lower in (False, True):
            d = 2 * i + lower
            docs.append((d, f"Hello all, <b>seen</b> this?\n{_replaced(p, known, lower)}\nwhat do you say"))
            forms = [L.template_of(w.lower(), known) for w in L.words_of(p)]
            slots = [sum(t in (L.NUMBER, L.NAME, L.UNIT) for t in forms[k : k + 12]) for k in range(len(forms) - 11)]
            if any(0 < n <= 12 - L.LEAST_PLAIN for n in slots):
                wanted.add((d, i))
    got = {(d, i) for d, i, _, c in _found(spark, docs, items) if c}
    assert len(wanted) > 200 and len(got & wanted) / len(wanted) >= 0.9
    shared = {p: {i for i, q in items if q == p} for _, p in items}
    of = dict(items)
    assert sum(i in shared[of[d // 2]] for d, i in got) / len(got) >= 0.9


def test_blocks_of_items(spark):
    items = [(i, " ".join(f"w{(i * 7 + k) % 50}x" for k in range(30))) for i in range(9)]
    docs = [(i, "so " + p) for i, p in items]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    whole, parts = (sorted(map(tuple, L.find_leaks(d, "doc_id", "text", it, "item_id", "passage", n).filter("n_verbatim > 0").select("doc_id", "item_id").collect())) for n in (10_000, 60))
    assert whole == parts == _brute(docs, items)


def test_empty_tables(spark):
    assert _found(spark, [(1, ITEM)], []) == [] and _found(spark, [], [(1, ITEM)]) == []
