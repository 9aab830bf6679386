"""Evaluation passages in training text.

Words are brought to templates: numbers, names and units of measure become
typed placeholders. Windows of WINDOW template words are hash-joined with those
of the items; the slots of a joined window are then compared. Equal slots are a
verbatim copy, slots that differ but are replaced consistently (each value
always by the same other one) a re-parameterised one.

What is a name is learnt from the items: a word that they never write in lower
case. The template of a word that an item has depends on the word alone, so equal
words always meet in the join. Words that no item has may stand for a name, and so
may, in a second reading of the text, any word with a capital.

Workers know the hashes of the items' windows and emit only windows that have one of
them. Items are taken in blocks of so many words that this stays small: the corpus
is read once for each block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
#: Words of the items (and so different words and windows) that are broadcast in one pass over the corpus: about 20 MB. More items take more passes.
WORDS_AT_ONCE = 500_000
#: So many words of a window must be no slots to call it re-parameterised.
LEAST_PLAIN = 6
MARKUP = re.compile(r"<[^<>]{0,60}>|\[[^\[\]]{0,60}\]|&[A-Za-z0-9#]{1,8};")
WORD = re.compile(r"[A-Za-z0-9]+")
#: Units of measure, time and money, in English, German and Spanish without accents.
UNITS = frozenset(
    """mm cm dm m km inch inches foot feet yard yards mile miles metre metres meter meters centimetre centimetres centimeter centimeters kilometre kilometres kilometer kilometers kilometern metros kilometros
    mg g kg t gram grams gramm kilogram kilograms kilo kilos gramos tonne tonnes tonnen tons ton pound pounds pfund libras ounce ounces unzen ml cl dl l litre litres liter liters litros cup cups tablespoons teaspoons
    ms s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years decade decades century centuries
    sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren segundo segundos minuto minutos hora horas dia dias semana semanas mes meses ano anos
    percent prozent degrees degree grad grados celsius fahrenheit crown crowns kronen euro euros eur dollar dollars usd cent cents pesos franken francs
    watt watts kw volt volts amp amps hz khz mhz ghz bit bits byte bytes kb mb gb tb pixel pixels rpm mph kmh""".split()
)
#: Numbers in words.
NUMBER_WORDS = frozenset(
    """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
    zwei drei vier funf sechs sieben acht neun zehn elf zwolf zwanzig dreissig vierzig hundert tausend dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil""".split()
)
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
_STEP = np.uint64(0x9E3779B97F4A7C15)

_WINDOWS = "key bigint, pos int, h bigint, template string, words string"


def words_of(text: str) -> list[str]:
    """Maximal runs of ASCII letters and digits, as written, after markup has become a blank."""
    return WORD.findall(MARKUP.sub(" ", text))


def template_of(low: str, known: dict[str, bool]) -> str:
    """The template of a word in lower case. known: the items' words, and whether they are names; a word that no item has may stand for one."""
    if low.isdigit() or low in NUMBER_WORDS:
        return NUMBER
    return UNIT if low in UNITS else NAME if known.get(low, True) else low


def _learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, is_name): words of passages in lower case, and whether they always have a capital."""
    for p in parts:
        seen: dict[str, bool] = {}
        for text in p["t"]:
            for w in words_of(text):
                low = w.lower()
                seen[low] = seen.get(low, True) and w[:1].isupper()
        yield pd.DataFrame(list(seen.items()), columns=["word", "is_name"])


class _Reader:
    """Windows of texts; hashes: sorted hashes of the windows that are wanted, None for all."""

    def __init__(self, known: dict[str, bool], hashes: np.ndarray | None) -> None:
        self.known, self.hashes = known, hashes
        self.codes: dict[str, int] = {}
        self.name = self._code(NAME)
        self.slots = np.array([self._code(t) for t in (NUMBER, NAME, UNIT)], np.uint64)

    def _code(self, template: str) -> int:
        return xxhash.xxh3_64_intdigest(template)

    def code(self, low: str) -> int:
        c = self.codes.get(low)
        if c is None:
            if len(self.codes) > WORDS_AT_ONCE:
                self.codes.clear()
            c = self.codes[low] = self._code(template_of(low, self.known))
        return c

    def wanted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, and the places of those wanted."""
        n = len(codes) - WINDOW + 1
        h = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            h = h * _STEP + codes[j : j + n]
        h = h.view(np.int64)
        if self.hashes is None:
            return h, np.arange(n)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return h, np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.array([], np.int64)

    def rows(self, keys, texts, as_written: bool) -> list[tuple]:
        """Windows (key, pos, h, template, words) of a batch of texts, in one array of codes. as_written: also with names for all words that have a capital."""
        words: list[str] = []
        owner: list[int] = []
        starts = []
        for k, t in enumerate(texts):
            starts.append(len(words))
            if isinstance(t, str):
                ws = words_of(t)
                words += ws
                owner += [k] * len(ws)
        if len(words) < WINDOW:
            return []
        lows = [w.lower() for w in words]
        of, codes = np.array(owner), np.fromiter(map(self.code, lows), np.uint64, len(lows))
        inside = of[WINDOW - 1 :] == of[: len(of) - WINDOW + 1]
        readings = [(codes, None)]
        if as_written:
            capital = np.fromiter((w[0].isupper() for w in words), bool, len(words)) & ~np.isin(codes, self.slots)
            readings.append((np.where(capital, np.uint64(self.name), codes), capital))
        out = []
        for values, capital in readings:
            h, at = self.wanted(values)
            for i in at[inside[at]].tolist():
                if capital is not None and not capital[i : i + WINDOW].any():
                    continue
                form = [NAME if capital is not None and capital[j] else template_of(lows[j], self.known) for j in range(i, i + WINDOW)]
                out.append((keys[of[i]], i - starts[of[i]], int(h[i]), " ".join(form), " ".join(lows[i : i + WINDOW])))
        return out


def _windows(rows: DataFrame, key: str, text: str, known: dict[str, bool], hashes: np.ndarray | None) -> DataFrame:
    """(key, pos, h, template, words) of windows: all of items (no hashes given), those with a hash of an item of documents."""
    shared = rows.sparkSession.sparkContext.broadcast((known, hashes))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(*shared.value)
        for p in parts:
            for i in range(0, len(p), 1000):
                some = p.iloc[i : i + 1000]
                yield pd.DataFrame(reader.rows(some["k"].tolist(), some["t"].tolist(), hashes is not None), columns=["key", "pos", "h", "template", "words"])

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, _WINDOWS)


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, n_verbatim, n_changed): every pair that shares a window, with the document's windows that are verbatim and those that are consistently re-parameterised.

    Null and short texts have no windows. Items may share a passage (each gets its
    pairs), documents may repeat; a pair comes once. Empty tables give no rows. A value
    must be replaced by the same other one inside a window, not across windows, as a
    document may have several variants of an item.
    """
    # Windows of equal passages are joined once and handed to their items at the end.
    texts = items.filter(F.col(passage).isNotNull()).groupBy(passage).agg(F.min(item_id).alias("first_item"))
    n_words = texts.agg(F.sum(F.size(F.split(passage, "[^A-Za-z0-9]+")))).first()[0] or 0
    blocks = max(1, math.ceil(n_words / words_at_once))
    judged = [_leaks_of_block(docs, doc_id, text, texts.filter(F.pmod(F.xxhash64(passage), F.lit(blocks)) == b), passage) for b in range(blocks)]
    per = judged[0]
    for more in judged[1:]:
        per = per.unionByName(more)
    members = items.select(item_id, passage).join(texts, passage).select(item_id, "first_item")
    return per.join(members, "first_item").select(doc_id, item_id, "n_verbatim", "n_changed")


def _leaks_of_block(docs: DataFrame, doc_id: str, text: str, texts: DataFrame, passage: str) -> DataFrame:
    learnt = texts.select(F.col(passage).alias("t")).mapInPandas(_learn, "word string, is_name boolean").groupBy("word").agg(F.min("is_name").alias("is_name"))
    known = {r["word"]: r["is_name"] for r in learnt.collect()}  # not more than the words of a block
    of_items = _windows(texts, "first_item", passage, known, None).select(F.col("key").alias("first_item"), "h", F.col("template").alias("its_template"), F.col("words").alias("its_words"))
    of_items = of_items.dropDuplicates(["first_item", "its_words"])
    hashes = np.array(sorted(r["h"] for r in of_items.select("h").distinct().collect()), np.int64)  # the same
    of_docs = _windows(docs, doc_id, text, known, hashes).withColumnRenamed("key", doc_id)
    joined = of_docs.join(of_items, "h").filter(F.col("template") == F.col("its_template"))
    slots = F.arrays_zip(F.split("template", " ").alias("t"), F.split("words", " ").alias("d"), F.split("its_words", " ").alias("i"))
    held = F.filter(slots, lambda s: s["t"].isin(NUMBER, NAME, UNIT))
    pairs, left, right = (F.size(F.array_distinct(F.transform(held, f))) for f in (lambda s: F.struct(s["d"], s["i"]), lambda s: s["d"], lambda s: s["i"]))
    same = F.col("words") == F.col("its_words")
    changed = ~same & (pairs == left) & (pairs == right) & (F.size(held) <= WINDOW - LEAST_PLAIN)
    judged = joined.select(doc_id, "first_item", "pos", same.alias("verbatim"), changed.alias("changed")).filter("verbatim or changed")
    n = lambda c: F.size(F.collect_set(F.when(F.col(c), F.col("pos"))))
    return judged.groupBy(doc_id, "first_item").agg(n("verbatim").alias("n_verbatim"), n("changed").alias("n_changed"))
