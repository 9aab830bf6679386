"""Schemas that drift between the files of a feed.

Each file's lines become a schema graph (names, types, nesting). For a file and
the one before it, similarity flooding scores the correspondences of fields:
scores start from names and shared values and are passed along nesting and types
until they converge; the best consistent pairs are kept, after an exact check of
the shared values. Renames followed through a feed give one consistent table.

Only field profiles (a few rows per file) are grouped per file; values are read
in a second pass, and only those of fields that are gone or new.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.durable import cut

STRING, NUMBER, BOOLEAN, ARRAY, OBJECT = 1, 2, 4, 8, 16
#: Share of the new field's different values that must be values of the old one.
LEAST_SHARED = 0.5
_FILE = ["feed", "file_no", "file_id"]


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_object(text: str | None) -> dict | None:
    """The JSON object of a line; None for null, invalid JSON, NaN and Infinity, and JSON that is no object."""
    if text is None:
        return None
    try:
        x = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def _type(v: Any) -> int:
    if v is None:
        return 0
    if isinstance(v, bool):
        return BOOLEAN
    return {str: STRING, int: NUMBER, float: NUMBER, list: ARRAY, dict: OBJECT}[type(v)]


def walk(obj: dict, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """(path, value) of every field, inside objects and objects in lists."""
    for k, v in obj.items():
        path = prefix + k
        yield path, v
        todo = [v]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                yield from walk(x, f"{path}.")
            elif isinstance(x, list):
                todo += x


def _canon(v: Any) -> Any:
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, list):
        return [_canon(x) for x in v]
    if isinstance(v, dict):
        return {k: _canon(x) for k, x in v.items()}
    return v


def value_hash(v: Any) -> bytes:
    """128 bits of a whole JSON value; fields of objects in any order, 1 and 1.0 alike."""
    return xxhash.xxh3_128_digest(json.dumps(_canon(v), sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass"))


def profile(lines: DataFrame) -> DataFrame:
    """(feed, file_no, file_id, path, types): every field of every file, types as a bit set (0: only nulls). Path '' stands for the file itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seen: dict[tuple, int] = {}
            for feed, no, fid, text in zip(p["feed"], p["file_no"], p["file_id"], p["payload"]):
                if (obj := parse_object(text)) is None:
                    continue
                seen[feed, no, fid, ""] = OBJECT
                for path, v in walk(obj):
                    k = (feed, no, fid, path)
                    seen[k] = seen.get(k, 0) | _type(v)
            yield pd.DataFrame([(*k, t) for k, t in seen.items()], columns=[*_FILE, "path", "types"])

    found = lines.select(*_FILE, "payload").mapInPandas(run, "feed string, file_no int, file_id string, path string, types int")
    return found.groupBy(*_FILE, "path").agg(F.bit_or("types").alias("types"))


def _eligible(old: dict[str, int], new: dict[str, int]) -> tuple[list[str], list[str], list[str]]:
    """Paths of changed type, gone and new, whose fields above are in both files with the same types."""

    def steady(path: str) -> bool:
        parts = path.split(".")
        above = [".".join(parts[:i]) for i in range(1, len(parts))]
        return all(a in old and a in new and old[a] == new[a] for a in above if a in old or a in new)

    changed = [p for p in old if p in new and old[p] and new[p] and old[p] != new[p] and steady(p)]
    gone = [p for p in old if p not in new and steady(p)]
    come = [p for p in new if p not in old and steady(p)]
    return sorted(changed), sorted(gone), sorted(come)


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def _pairs(old: dict[str, int], new: dict[str, int], gone: list[str], come: list[str]) -> list[tuple[str, str]]:
    return [(o, n) for o in gone for n in come if _parent(o) == _parent(n) and old[o] and old[o] == new[n]]


def _name_score(a: str, b: str) -> float:
    grams = lambda s: {f"^{s.lower()}$"[i : i + 3] for i in range(len(s))}
    x, y = grams(a.rpartition(".")[2]), grams(b.rpartition(".")[2])
    return len(x & y) / max(1, len(x | y))


def flood(old: dict[str, int], new: dict[str, int], start: dict[tuple[str, str], float], rounds: int = 60, eps: float = 1e-4) -> dict[tuple[str, str], float]:
    """Scores of field pairs after similarity flooding over nesting and types, from their start scores."""
    pairs = list(start)
    index = {p: i for i, p in enumerate(pairs)}
    types = sorted({(old[o], new[n]) for o, n in pairs})
    t_index = {t: len(pairs) + i for i, t in enumerate(types)}
    size = len(pairs) + len(types)
    links = [(index[p], t_index[old[p[0]], new[p[1]]]) for p in pairs]
    links += [(index[up], index[p]) for p in pairs if (up := (_parent(p[0]), _parent(p[1]))) in index and up != p]
    flow = np.zeros((size, size))
    for a, b in links:
        flow[a, b] = flow[b, a] = 1.0
    flow /= np.maximum(flow.sum(axis=1, keepdims=True), 1)
    s0 = np.array([start[p] for p in pairs] + [1.0 if a == b else 0.0 for a, b in types])
    s = s0.copy()
    for _ in range(rounds):
        following = s0 + s + flow.T @ (s0 + s)
        following /= max(following.max(), 1e-12)
        done = np.abs(following - s).max() < eps
        s = following
        if done:
            break
    return {p: float(s[i]) for p, i in index.items()}


_PAIR = ["feed", "pair_no"]


def _fields(rows) -> dict[str, int]:
    return {r["path"]: int(r["types"]) for r in rows if r["path"]}


def _candidates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fields of two files that may be one renamed: feed, pair_no, the files and both paths."""
    for p in parts:
        rows = []
        for feed, no, old_file, new_file, o, n in zip(p["feed"], p["pair_no"], p["old_file"], p["new_file"], p["old"], p["new"]):
            old, new = _fields(o), _fields(n)
            _, gone, come = _eligible(old, new)
            rows += [(feed, no, old_file, new_file, *pair) for pair in _pairs(old, new, gone, come)]
        yield pd.DataFrame(rows, columns=[*_PAIR, "old_file", "new_file", "old_path", "new_path"])


def compare(old: dict[str, int], new: dict[str, int], shared: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str, str]]:
    """(change_kind, old_path, new_path) of two schemas; shared: different values of the new field that the old one has, and all."""
    changed, gone, come = _eligible(old, new)
    start = {(p, p): 1.0 for p in old if p in new}
    for o, n in _pairs(old, new, gone, come):
        c, k = shared.get((o, n), (0, 0))
        start[o, n] = 0.3 * _name_score(o, n) + 0.7 * (c / k if k else 0.0)
    scores = flood(old, new, start) if any(o != n for o, n in start) else {}
    renamed: dict[str, str] = {}
    for (o, n), _ in sorted(((p, s) for p, s in scores.items() if p[0] != p[1]), key=lambda x: (-x[1], x[0])):
        c, k = shared.get((o, n), (0, 0))
        if k and c >= LEAST_SHARED * k and o not in renamed and n not in renamed.values():
            renamed[o] = n
    rows = [("type_changed", p, p) for p in changed] + [("renamed", o, n) for o, n in renamed.items()]
    return rows + [("removed", p, "") for p in gone if p not in renamed] + [("added", "", p) for p in come if p not in renamed.values()]


def _changes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for feed, no, fid, o, n, shared in zip(p["feed"], p["pair_no"], p["new_file"], p["old"], p["new"], p["shared"]):
            common = {(x["old_path"], x["new_path"]): (int(x["common"]), int(x["n_new"])) for x in ([] if shared is None else shared)}
            rows += [(feed, no, fid, *x) for x in compare(_fields(o), _fields(n), common)]
        yield pd.DataFrame(rows, columns=["feed", "file_no", "file_id", "change_kind", "old_path", "new_path"])


def changes(lines: DataFrame) -> DataFrame:
    """(feed, file_no, file_id, change_kind, old_path, new_path): every change between a file and the one before it in its feed.

    lines: feed, file_no, file_id, payload. Repeated lines and deliveries do not
    matter, nor does their order; lines that are null or no JSON objects count for
    nothing, and a file of only such lines is no file. The first file of a feed has
    no changes; an empty table gives no rows.
    """
    # One row for each file with all its fields: as many as its schema has, whatever its lines.
    files = profile(lines).groupBy(*_FILE).agg(F.array_sort(F.collect_list(F.struct("path", "types"))).alias("new"))
    w = Window.partitionBy("feed").orderBy("file_no", "file_id")
    pairs = files.withColumns({"old": F.lag("new").over(w), "old_file": F.lag("file_id").over(w)}).filter(F.col("old") != F.col("new"))
    differ = cut(pairs.select("feed", F.col("file_no").alias("pair_no"), "old_file", F.col("file_id").alias("new_file"), "old", "new"))
    cands = cut(differ.mapInPandas(_candidates, "feed string, pair_no int, old_file string, new_file string, old_path string, new_path string"))
    want = lambda side: cands.select("feed", F.col(f"{side}_file").alias("file_id"), F.struct("pair_no", F.lit(side).alias("side"), F.col(f"{side}_path").alias("path")).alias("w"))
    wanted = want("old").unionByName(want("new")).groupBy("feed", "file_id").agg(F.collect_set("w").alias("wanted"))

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seen = set()
            for feed, text, want in zip(p["feed"], p["payload"], p["wanted"]):
                if (obj := parse_object(text)) is None:
                    continue
                to: dict[str, list] = {}
                for w in want:
                    to.setdefault(w["path"], []).append((w["pair_no"], w["side"]))
                for path, v in walk(obj):
                    if v is not None and path in to:
                        h = value_hash(v)
                        seen.update((feed, no, side, path, h) for no, side in to[path])
            yield pd.DataFrame(list(seen), columns=["feed", "pair_no", "side", "path", "value"])

    # Spark broadcasts `wanted` only if it is below its own size limit.
    found = lines.select("feed", "file_id", "payload").join(wanted, ["feed", "file_id"]).mapInPandas(values, "feed string, pair_no int, side string, path string, value binary")
    found = found.distinct()
    paths = cands.select(*_PAIR, "old_path", "new_path")
    new_values = found.filter(F.col("side") == "new").select(*_PAIR, F.col("path").alias("new_path"), "value").join(paths, [*_PAIR, "new_path"])
    old_values = found.filter(F.col("side") == "old").select(*_PAIR, F.col("path").alias("old_path"), "value", F.lit(1).alias("hit"))
    shared = new_values.join(old_values, [*_PAIR, "old_path", "value"], "left").groupBy(*_PAIR, "old_path", "new_path").agg(F.count("hit").alias("common"), F.count(F.lit(1)).alias("n_new"))
    shared = shared.groupBy(*_PAIR).agg(F.collect_list(F.struct("old_path", "new_path", "common", "n_new")).alias("shared"))
    both = differ.join(shared, _PAIR, "left").select(*_PAIR, "new_file", "old", "new", "shared")
    return both.mapInPandas(_changes, "feed string, file_no int, file_id string, change_kind string, old_path string, new_path string")


def canonical_names(found: DataFrame) -> DataFrame:
    """(feed, from_no, to_no, path, name): under which first name a field goes in the files from from_no to before to_no, from the renames in changes()."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, current = [], {}
        for r in g.sort_values(["file_no", "old_path"]).itertuples():
            began, name = current.pop(r.old_path, (0, r.old_path))
            if r.old_path != name:
                rows.append((r.feed, began, r.file_no, r.old_path, name))
            current[r.new_path] = (r.file_no, name)
        rows += [(g.iloc[0]["feed"], began, 2**31 - 1, p, name) for p, (began, name) in current.items() if p != name]
        return pd.DataFrame(rows, columns=["feed", "from_no", "to_no", "path", "name"])

    renames = found.filter(F.col("change_kind") == "renamed").select("feed", "file_no", "old_path", "new_path")
    return renames.groupBy("feed").applyInPandas(run, "feed string, from_no int, to_no int, path string, name string")


def _rename(obj: dict, names: dict[str, str], prefix: str = "") -> dict:
    """obj under canonical names. Of two fields that would get one name, a renamed one has it; the other gets # behind it."""
    out: dict = {}
    for k in sorted(obj, key=lambda k: (prefix + k not in names, k)):
        path = prefix + k
        deep = lambda x: _rename(x, names, f"{path}.") if isinstance(x, dict) else [deep(y) for y in x] if isinstance(x, list) else x
        name = names[path].rpartition(".")[2] if path in names else k
        while name in out:
            name += "#"
        out[name] = deep(obj[k])
    return out


def _number(v: Any) -> tuple[float | None, bool]:
    try:
        x = float(v)
    except (TypeError, ValueError, OverflowError):
        return None, False
    if isinstance(v, bool) or not np.isfinite(x):
        return x, False
    try:
        return x, int(v) == x if isinstance(v, str) else x == v
    except ValueError:
        return x, "_" not in v


def fit_whole(v: Any, kind: Any) -> tuple[Any, bool]:
    """fit(v, kind), and whether all of v's non-null values are in it."""
    if v is None:
        return None, True
    if isinstance(kind, (list, dict)) and isinstance(v, str) and v[:1] in "[{":
        try:
            v = json.loads(v, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            pass
    if isinstance(kind, list):
        got = [fit_whole(x, kind[0]) for x in (v if isinstance(v, list) else [v])]
        return [x for x, _ in got], all(w for _, w in got)
    if isinstance(v, list):
        if len(v) == 1:
            return fit_whole(v[0], kind)
        return (json.dumps(v), True) if v and kind == "string" else (None, False)
    if isinstance(kind, dict):
        if not isinstance(v, dict):
            return None, False
        got = {k: fit_whole(v.get(k), t) for k, t in kind.items()}
        return {k: x for k, (x, _) in got.items()}, all(w for _, w in got.values()) and all(x is None for k, x in v.items() if k not in kind)
    if isinstance(v, dict):
        if "id" in v:
            x, whole = fit_whole(v["id"], kind)
            return x, whole and all(y is None for k, y in v.items() if k != "id")
        return (json.dumps(v, sort_keys=True), True) if kind == "string" else (None, False)
    if kind == "number":
        return _number(v)
    return (v if isinstance(v, str) else json.dumps(v)), True


def fit(v: Any, kind: Any) -> Any:
    """A JSON value in the wanted shape: 'string', 'number', [kind] or {field: kind}. Lists are unwrapped or wrapped, JSON in strings is read; what does not fit is None."""
    return fit_whole(v, kind)[0]


def unify(lines: DataFrame, names: DataFrame, target: dict[str, Any], ddl: str) -> DataFrame:
    """One consistent table (line_id, feed, file_id, the columns of ddl, rest) of the valid lines of all files.

    Fields go under their canonical names and are cast to target, whose fields are
    those of ddl; of different spellings of a name (letter case) the exact one counts.
    rest has the JSON of every other field that is not null, and of every field that
    its column does not hold whole, by canonical name; null if there is none.
    """
    wanted = names.groupBy("feed").agg(F.collect_list(F.struct("from_no", "to_no", "path", "name")).alias("names"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for line, feed, fid, no, text, want in zip(p["line_id"], p["feed"], p["file_id"], p["file_no"], p["payload"], p["names"]):
                if (obj := parse_object(text)) is None:
                    continue
                to = {w["path"]: w["name"] for w in ([] if want is None else want) if w["from_no"] <= no < w["to_no"]}
                record, rest = {}, {}
                for k, v in _rename(obj, to).items():
                    if k in target:
                        record[k], whole = fit_whole(v, target[k])
                    if v is not None and not (k in target and whole):
                        rest[k] = json.dumps(v, sort_keys=True)
                rows.append((line, feed, fid, json.dumps(record), dict(sorted(rest.items())) or None))
            yield pd.DataFrame(rows, columns=["line_id", "feed", "file_id", "record", "rest"])

    out = lines.select("line_id", "feed", "file_id", "file_no", "payload").join(wanted, "feed", "left").mapInPandas(run, "line_id bigint, feed string, file_id string, record string, rest map<string,string>")
    return out.withColumn("r", F.from_json("record", ddl)).select("line_id", "feed", "file_id", "r.*", "rest")
