"""Subject areas of documents.

Weighted subject terms (words and pairs of words) are matched by a multi-pattern
automaton in what the author wrote. Curators give the areas' descriptions and label
documents: a term's weight for an area grows with how much more often labelled
documents of the area have it, and with its rarity. Words that all areas have alike
so get no weight; whole sentences that are spread over areas (figures of speech,
greetings) are left out. The
terms of a sentence decide on the sentence's area, and an area's evidence is
normalised by the length (sentences with subject terms) of the document. Every
area whose evidence exceeds thresholds calibrated on labelled documents is
assigned; documents with words but without evidence are small talk.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.posts import own_text

#: Labelled documents that terms and thresholds are fitted on, at most (a sample by hash of the id).
MOST_LABELLED = 20_000
#: One in so many of them is held back from the terms while thresholds are calibrated on it.
HELD_BACK = 5
SMALL_TALK = "everyday"
#: Stands before a term that is a whole sentence.
WHOLE = "="
#: A sentence is a set phrase if none of its areas has more than this share of its documents.
SPREAD = 0.5
#: By so much weight the first area of a sentence must exceed the second one to be sure of.
CLEAR = 2.0
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?…\n]+")


def sentences(text: str) -> list[list[str]]:
    """Words of every sentence in lower case."""
    every = ([w.lower().replace("’", "'") for w in _WORD.findall(s)] for s in _SENTENCE.split(text))
    return [words for words in every if words]


#: Frequent words by which a text's language is told; each language has its own shares of areas.
FUNCTION_WORDS = {
    "en": frozenset("the and to is a of has on if our my than with before it's".split()),
    "de": frozenset("ist und nicht für war habe ich aus mir als hier wer mit nach".split()),
    "es": frozenset("que de y no se para es me el la sin nada creo desde".split()),
}


def language(words: list[str]) -> str:
    """The language whose function words a text has most of."""
    return max(FUNCTION_WORDS, key=lambda k: sum(w in FUNCTION_WORDS[k] for w in words))


def _count_terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, lang, area, held, n): documents of one label that have the term; term '' counts the documents."""
    counts: dict[tuple[str, str, str, bool], int] = defaultdict(int)
    for p in parts:
        for text, areas, held in zip(p["text"], p["areas"], p["held"]):
            own = own_text(text)
            if len(areas) != 1 or not own:
                continue
            said = sentences(own)
            lang = language([w for ws in said for w in ws])
            terms = {""}
            for ws in said:
                terms.update(ws)
                terms.update(f"{a} {b}" for a, b in zip(ws, ws[1:]))
                terms.add(WHOLE + " ".join(ws))
            for t in terms:
                counts[t, lang, areas[0], bool(held)] += 1
    yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["term", "lang", "area", "held", "n"])


def curated(descriptions: dict[str, str]) -> dict[str, dict[str, float]]:
    """Terms that the areas' own descriptions name, each of one area only; what labels say of a term counts more."""
    areas_of: dict[str, set[str]] = defaultdict(set)
    for area, text in descriptions.items():
        for ws in sentences(text or ""):
            for w in {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))} - FUNCTION_WORDS["en"]:
                areas_of[w].add(area)
    return {w: {min(a): 2.0} for w, a in areas_of.items() if len(a) == 1}


def weigh(counts: pd.DataFrame, known: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """Weights of terms from (term, lang, area, n), and from those known before.

    The log of how much likelier the area is with the term than in the language of
    the documents that have it, lowered for terms that are not rare.
    """
    totals: dict[tuple[str, str], int] = {}
    by_term: dict[str, dict[tuple[str, str], int]] = defaultdict(dict)
    for t, lang, a, n in counts[["term", "lang", "area", "n"]].itertuples(index=False):
        cells = by_term[t] if t else totals
        cells[lang, a] = cells.get((lang, a), 0) + int(n)
    n_docs = max(1, sum(totals.values()))
    of_lang: dict[str, int] = defaultdict(int)
    of_area: dict[str, int] = defaultdict(int)
    for (lang, a), n in totals.items():
        of_lang[lang] += n
        of_area[a] += n
    # Shares in a language lean on those in all languages, as if by ten more documents.
    prior = {(lang, a): (totals.get((lang, a), 0) + 10 * of_area[a] / n_docs) / (of_lang[lang] + 10) for lang in of_lang for a in of_area}
    lexicon = dict(known)
    for t, cells in by_term.items():
        df = sum(cells.values())
        if df < 3:
            continue
        if t.startswith(WHOLE):
            per_area = defaultdict(int)
            for (_, a), n in cells.items():
                per_area[a] += n
            if max(per_area.values()) <= SPREAD * df:
                lexicon[t] = {}
            continue
        rarity = min(1.0, math.log(n_docs / df + 1) / math.log(12))
        expected: dict[str, float] = defaultdict(float)
        got: dict[str, int] = defaultdict(int)
        for (lang, a), n in cells.items():
            got[a] += n
            for area in of_area:
                expected[area] += n / df * prior[lang, area]
        weights = {}
        for a, n in got.items():
            p = (n + 0.5 * expected[a]) / (df + 0.5)
            if n >= 2 and p > 0.3 and p > 2 * expected[a]:
                weights[a] = math.log(p / expected[a]) * rarity
        if weights:
            lexicon[t] = weights
        elif df >= 6:
            lexicon.pop(t, None)
    return lexicon


class Matcher:
    """An automaton over the terms of a lexicon."""

    def __init__(self, lexicon: dict[str, dict[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        self.set_phrases = {t[len(WHOLE) :] for t in lexicon if t.startswith(WHOLE)}
        terms = [(t, w) for t, w in lexicon.items() if w]
        for t, w in terms:
            self.automaton.add_word(f" {t} ", (t, w))
        if terms:
            self.automaton.make_automaton()
        self.empty = not terms

    def evidence(self, text: str) -> tuple[dict[str, tuple[int, float]], int, int]:
        """For each area its sentences and their weight; the sentences with any area; all sentences. Set phrases say nothing."""
        every = sentences(text)
        said = [ws for ws in every if " ".join(ws) not in self.set_phrases]
        votes_of: list[dict[str, float]] = []
        clear: dict[str, float] = defaultdict(float)
        for ws in said:
            votes: dict[str, float] = defaultdict(float)
            # Terms of a sentence count once; the automaton sees overlapping ones.
            hits = {} if self.empty else {t: w for _, (t, w) in self.automaton.iter(f" {' '.join(ws)} ")}
            for w in hits.values():
                for a, x in w.items():
                    votes[a] += x
            votes_of.append(votes)
            if votes:
                first, second = sorted([*votes.values(), 0.0], reverse=True)[:2]
                if first - second >= CLEAR:
                    clear[max(votes, key=lambda k: (votes[k], k))] += 1
        found: dict[str, list[float]] = {}
        n_clear = sum(clear.values())
        for votes in votes_of:
            if votes:
                # Terms of several areas follow what the rest of the text is about.
                a = min(votes, key=lambda k: (-votes[k] - (CLEAR * clear[k] / n_clear if n_clear else 0.0), k))
                if votes[a] >= 1.5:
                    found.setdefault(a, []).append(votes[a])
        found.pop(SMALL_TALK, None)
        return {a: (len(v), sum(v)) for a, v in found.items()}, sum(map(len, found.values())), len(every)


def decide(evidence: dict[str, tuple[int, float]], n_subject: int, n_all: int, share: float, least: int) -> list[str]:
    """Areas on at least `least` sentences or `share` of the sentences with a subject; small talk if there are words but no subject."""
    if not evidence:
        return [SMALL_TALK] if n_all else []
    best = max(evidence.values())
    return sorted(a for a, v in evidence.items() if v[0] >= least or v[0] >= share * n_subject or v == best)


def _counted(sample: DataFrame) -> pd.DataFrame:
    """What executors count in the labelled texts (text, areas, held): terms of three documents or more, which are few as the texts are."""
    counts = sample.select("text", "areas", "held").mapInPandas(_count_terms, "term string, lang string, area string, held boolean, n bigint")
    counts = counts.groupBy("term", "lang", "area", "held").agg(F.sum("n").alias("n"))
    often = counts.groupBy("term").agg(F.sum("n").alias("df")).filter("df >= 3 or term = ''").select("term")
    return counts.join(often, "term", "left_semi").toPandas()


def _scorer(lexicon):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(lexicon.value)
        for p in parts:
            rows = []
            for d, text in zip(p["doc_id"], p["text"]):
                own = own_text(text)
                if own is None:
                    continue
                ev, n_subject, n_all = m.evidence(own)
                rows += [(d, a, n, w, n_subject, n_all) for a, (n, w) in ev.items()] or [(d, None, 0, 0.0, 0, n_all)]
            yield pd.DataFrame(rows, columns=["doc_id", "area", "n", "weight", "n_subject", "n_all"])

    return run


_SCORED = "doc_id bigint, area string, n int, weight double, n_subject int, n_all int"


def _calibrate(scored: list, truth: dict[int, set[str]]) -> tuple[float, int]:
    """The thresholds of best F1 on the labelled sample."""
    docs: dict[int, tuple[dict, int, int]] = {}
    for r in scored:
        ev, _, _ = docs.setdefault(r["doc_id"], ({}, r["n_subject"], r["n_all"]))
        if r["area"] is not None:
            ev[r["area"]] = (r["n"], r["weight"])
    best = (-1.0, 0.34, 2)
    for share in (0.15, 0.2, 0.25, 0.3, 0.34, 0.4, 0.5):
        for least in (1, 2, 3, 4):
            hit = wrong = 0
            for d, (ev, n_subject, n_all) in docs.items():
                got = set(decide(ev, n_subject, n_all, share, least))
                hit += len(got & truth[d])
                wrong += len(got ^ truth[d])
            f1 = 2 * hit / max(1, 2 * hit + wrong)
            if f1 > best[0] + 1e-9:
                best = (f1, share, least)
    return best[1], best[2]


def assign_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, area) of every document that has any.

    docs: doc_id, text; labels: doc_id, area; areas: area, description. Null, blank and
    removed texts have no row, nor have texts of nothing but quotes. Terms and
    thresholds are fitted on about most_labelled labelled documents, those of the
    smallest hashes of their ids; all documents are matched, whole. Repeated labels
    count once. Thresholds are calibrated on labelled documents that the terms then
    used have not seen. Without labels only the terms of the descriptions count;
    without those, too, every text is small talk.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    # One short text for each area.
    known = curated({r["area"]: r["description"] for r in areas.filter(F.col("area").isNotNull()).select("area", "description").collect()}) if areas is not None else {}
    labelled = labels.select("doc_id", "area").filter(F.col("area").isNotNull())
    n = labelled.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    at = F.xxhash64("doc_id")
    if n > most_labelled:
        labelled = labelled.filter(at < F.lit(int((most_labelled / n - 0.5) * 2.0**64)))
    chosen = labelled.groupBy("doc_id").agg(F.array_sort(F.collect_set("area")).alias("areas")).withColumn("held", F.pmod(at, F.lit(HELD_BACK)) == 0)
    sample = docs.join(F.broadcast(chosen), "doc_id")  # about most_labelled short rows
    counts = _counted(sample)
    judge = spark.sparkContext.broadcast(weigh(counts[~counts["held"]], known))
    scored = sample.filter("held").select("doc_id", "text").mapInPandas(_scorer(judge), _SCORED).collect()
    truth = {r["doc_id"]: set(r["areas"]) for r in chosen.filter("held").collect()}
    share, least = _calibrate(scored, truth)
    lexicon = spark.sparkContext.broadcast(weigh(counts, known))

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(lexicon.value)
        for p in parts:
            rows = []
            for d, text in zip(p["doc_id"], p["text"]):
                if (own := own_text(text)) is not None:
                    rows += [(d, a) for a in decide(*m.evidence(own), share, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "area"])

    return docs.mapInPandas(label, "doc_id bigint, area string")
