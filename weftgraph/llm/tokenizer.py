"""Byte-pair encoding of a whole corpus by prefix dynamic programming.

For every prefix of a byte string there is exactly one last token of its
encoding, and it is the only token that ends there and goes with the last token
of the prefix before it. A table of these tokens is built from left to right,
without ever merging again: bytes can be appended at the cost of the new bytes,
and an edit only has to be followed until the table agrees with the old one.

Vocabularies are files `base64 rank` a line; ranks are ids and merge order.
They are read by the driver from a path that is a parameter, and broadcast (a
vocabulary does not grow with the corpus).
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How byte_bpe_50k cuts a text before encoding.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker remembers of pieces and of token pairs; beyond it forgets all and begins again.
MEMORY = 400_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """Encodes byte strings by a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern)
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def _merge(self, raw: bytes) -> list[bytes]:
        """Plain merging by rank, for short strings only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: their joined bytes are encoded as just these two."""
        k = (a, b)
        if (v := self._fits.get(k)) is None:
            if len(self._fits) >= MEMORY:
                self._fits.clear()
            x, y = self.bytes_of[a], self.bytes_of[b]
            v = self._fits[k] = self._merge(x + y) == [x, y]
        return v

    def fill(self, raw: bytes, last: list[int], upto: int | None = None) -> None:
        """Goes on with the table: last[i] is the last token of raw[: i + 1]."""
        for end in range(len(last) + 1, (len(raw) if upto is None else upto) + 1):
            for start in range(max(0, end - self.longest), end):
                t = self.ranks.get(raw[start:end])
                if t is not None and (start == 0 or self.fits(last[start - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("a single byte is missing in the vocabulary")

    def walk_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return ids[::-1]

    def encode_bytes(self, raw: bytes) -> list[int]:
        last: list[int] = []
        self.fill(raw, last)
        return self.walk_back(last)

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special tokens; lone surrogates become the replacement character."""
        ids: list[int] = []
        pieces = self._pieces
        for p in self.split.findall(text):
            known = pieces.get(p)
            if known is None:
                if len(pieces) >= MEMORY:
                    pieces.clear()
                known = self.encode_bytes(p.encode("utf-8", "replace"))
                if len(p) <= 64:
                    pieces[p] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def _looked_at(text: str, start: int, end: int) -> int:
    """How far the piece text[start:end] may have been decided by what stands there: a contraction looks three characters ahead, blanks look at the end of their run and the next character."""
    if text[start].isspace():
        while end < len(text) and text[end].isspace():
            end += 1
    return max(end + 1, start + 4)


class EncodedText:
    """A text with its pieces and their tables of last tokens, so that appends and edits encode only what is near them.

    The pattern has no look-behind: from one border on, equal rests are cut alike. A
    piece that was decided before an edit's begin stays; behind the edit cutting stops
    where a border of the old text is met. A piece that only grew at its end goes on
    with its own table.
    """

    def __init__(self, enc: PrefixEncoder, text: str) -> None:
        self.enc, self.text = enc, text
        self.borders: list[int] = [0]
        self.tables: list[list[int]] = []
        #: Bytes that the last change took to encode.
        self.encoded = 0
        self._cut(0, lambda at: False)

    def _raw(self, a: int, b: int) -> bytes:
        return self.text[a:b].encode("utf-8", "replace")

    def _cut(self, at: int, enough, grown: tuple[bytes, list[int]] | None = None) -> None:
        """Cuts and encodes from the last border, `at`, on, until the end or a border that is enough."""
        for m in self.enc.split.finditer(self.text, at):
            raw = self._raw(m.start(), m.end())
            table: list[int] = []
            if grown and m.start() == at and raw.startswith(grown[0]):
                table = list(grown[1])
            self.encoded += len(raw) - len(table)
            self.enc.fill(raw, table)
            self.tables.append(table)
            self.borders.append(m.end())
            if enough(m.end()):
                return

    def replace(self, start: int, stop: int, new: str) -> None:
        """Puts new in the place of text[start:stop]."""
        old, borders, tables = self.text, self.borders, self.tables
        keep = bisect_right(borders, start) - 1
        while keep > 0 and _looked_at(old, borders[keep - 1], borders[keep]) > start:
            keep -= 1
        # What comes before a decided piece is decided, too: no piece looks further ahead than the one behind it.
        self.text, shift = old[:start] + new + old[stop:], len(new) - (stop - start)
        self.borders, self.tables, self.encoded = borders[: keep + 1], tables[:keep], 0
        at, met = borders[keep], []

        def enough(end: int) -> bool:
            i = bisect_left(borders, end - shift) if end >= start + len(new) else len(borders)
            if i < len(borders) and borders[i] == end - shift and borders[i] >= stop:
                met.append(i)
                return True
            return False

        grown = None
        if keep < len(tables) and borders[keep + 1] <= start:
            grown = (old[at : borders[keep + 1]].encode("utf-8", "replace"), tables[keep])
        if not (start + len(new) == at and enough(at)):
            self._cut(at, enough, grown)
        if met:
            self.borders += [b + shift for b in borders[met[0] + 1 :]]
            self.tables += tables[met[0] :]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    @property
    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.enc.walk_back(t)]


_encoders: dict[str, PrefixEncoder] = {}


def _encoder(vocabulary: str, ranks) -> PrefixEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = PrefixEncoder(ranks.value)
    return _encoders[vocabulary]


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, the columns more, ids): every row with the ids of its text.

    Null and empty texts have the empty list; blank ones are encoded like any
    other, and strings that look like special tokens are ordinary text. Rows are
    independent: repeated keys give repeated rows, an empty table none, other
    columns do not matter. No shuffle.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary, ranks)
        for p in parts:
            ids = [enc.encode(t) if isinstance(t, str) else [] for t in p["_text"]]
            yield p.drop(columns="_text").assign(ids=ids)

    cols = list(dict.fromkeys([key, *more]))
    schema = T.StructType([*[docs.schema[c] for c in cols], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*cols, F.col(text).alias("_text")).mapInPandas(run, schema)


def reposts(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, original, ids, n_encoded): documents whose text is that of another but for letter case, blanks and punctuation, encoded by editing the tables of the original (the smallest key).

    n_encoded: bytes that were encoded for the ids, of all of the text's. Texts
    without letters and digits, and originals, have no row. A document meets one
    original, whatever the number of copies; equal texts are edited by nothing.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    plain = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    of = docs.filter(plain != "").select(F.col(key), F.col(text).alias("t"), F.xxhash64(plain).alias("d1"), F.xxhash64(F.lit(7), plain).alias("d2"))
    first = of.groupBy("d1", "d2").agg(F.min(F.struct(F.col(key).alias("k"), F.col("t").alias("t"))).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = of.join(first, ["d1", "d2"]).filter(F.col(key) != F.col("f.k")).select(key, F.col("f.k").alias("original"), F.col("t").alias("new_text"), F.col("f.t").alias("old_text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary, ranks)
        for p in parts:
            ids, cost = [], []
            for old, new in zip(p["old_text"], p["new_text"]):
                e = EncodedText(enc, old)
                e.encoded = 0
                head = len(commonprefix([old, new]))
                tail = len(commonprefix([old[head:][::-1], new[head:][::-1]]))
                if old != new:
                    e.replace(head, len(old) - tail, new[head : len(new) - tail])
                ids.append(e.ids)
                cost.append(e.encoded)
            yield pd.DataFrame({key: p[key], "original": p["original"], "ids": ids, "n_encoded": cost})

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("original", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_encoded", T.LongType())])
    return pairs.mapInPandas(run, schema)
