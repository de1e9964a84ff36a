"""Toxicity from a learned lexicon that also finds misspelled terms.

Lexicon. Words and stems (first letters, whatever follows) that labelled toxic texts hold
far more often than clean ones, each text counted once. Of these, the one that most toxic texts hold is taken, then the one that most texts with fewer than
``COVER`` terms so far hold, and so on, as long as these are ``support`` of the toxic texts
drawn: words that only occur next to better ones in a few copies are left out. So there are at
most ``COVER`` / ``support`` terms, of at most a text's mean words and stems / ``support``
looked at; neither number is cut. Words of more than ``LONGEST`` letters are known by their stems.

Matching. The terms form a trie. Its product with the Levenshtein automata of its terms (one
edit for words of ``FUZZY_FROM`` letters and stems of ``FUZZY_STEM`` letters and more) is made deterministic once and run over
all words of a block of texts together, letter by letter; words leave as soon as no term is
in reach.

Context. Around a match, quotation marks that enclose it and words of report speak for a
quotation, words of address for abuse; the balance tells whether the match counts as quoted.

Score. For each term, distance and context the share of toxic texts among labelled texts
with such a match, smoothed by that of all terms at the same distance and context, and that
by a fixed prior. A text's score is the largest of its matches, or the share among labelled
texts without a match. Labelled texts are weighted so that shares are those of all labels.

Scale. ``fit`` looks at the rows of about ``sample`` labelled ids of either class, drawn by
hash; these ids are the only broadcast. If the rows of these ids hold more texts than that, as
where ids repeat, the texts are drawn by hash as well. Words are counted inside tasks before they are shuffled. Scoring
is one pass without a shuffle.

Defined cases. A text that is null or empty has no match and the score of such texts. A row
without a label teaches nothing; if labels of an id or a text contradict, it is toxic. If
either class is missing, scores are the share of toxic labels, or 0 without labels. Repeated
rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import arrays, code_points, drawn, fresh, letters, share_of, texts, works_for
from tallyrank.session import write_through

FUZZY_FROM, FUZZY_STEM = 4, 6
SHORTEST, LONGEST = 3, 24
#: Lengths of stems.
STEMS = range(4, 11)
#: Terms that a toxic text must hold to need no more.
COVER = 4
#: Ends a term that is a whole word.
WHOLE = "$"
#: Characters looked at on either side of a match.
AROUND = 60
#: Words and stems a task counts before it gives its counts away.
HELD_WORDS = 300_000
#: Share of toxic texts assumed for (distance, quoted) before any is seen.
PRIOR = {(0, False): 0.9, (0, True): 0.5, (1, False): 0.6, (1, True): 0.3}
#: Strength of that prior, and of the pooled share for a single term, in texts.
TRUST = 2.0
QUOTES = "\"“”„‟«»‹›"
_REPORT = re.compile(
    r"\b(said|says|quote|quoted|quotes|called|wrote|writes|term|word|dijo|dice|escribió|sagte|schrieb|"
    r"zitat|wort|dit|écrit|cité|mot)\b"
)
_ADDRESS = re.compile(r"\b(you|your|you're|ur|du|dich|dein|ihr|tu|te|ton|vous|votre|eres|usted|vosotros)\b")


# --- automaton ---------------------------------------------------------------


def allowed(term: str) -> int:
    """Edits within reach of a term."""
    if term.endswith(WHOLE):
        return 1 if len(term) - 1 >= FUZZY_FROM else 0
    return 1 if len(term) >= FUZZY_STEM else 0


def features(text: str) -> set[str]:
    """The words of a lower-cased text, and their stems."""
    start, length = words_of(code_points(text))
    words = {text[s:s + n] for s, n in zip(start.tolist(), length.tolist()) if n >= SHORTEST}
    stems = {w[:n] for w in words for n in STEMS if len(w) >= n}
    return stems | {w + WHOLE for w in words if len(w) <= LONGEST}


@dataclass(frozen=True)
class Automaton:
    """Accepts the words within reach of a term. State 0 is dead, state 1 the start.

    ``term`` and ``distance`` say what a word that ends in a state matches, ``stem`` and
    ``stem_distance`` what it matches however it goes on; -1 is nothing.
    """

    terms: tuple[str, ...]
    symbols: dict[str, int]
    step: np.ndarray
    term: np.ndarray
    distance: np.ndarray
    stem: np.ndarray
    stem_distance: np.ndarray

    @staticmethod
    def of(terms: tuple[str, ...]) -> Automaton:
        below: list[dict[str, int]] = [{}]
        ends: dict[int, list[int]] = {}
        lasting: set[int] = set()
        most = [0]
        for i, term in enumerate(terms):
            at = 0
            most[0] = max(most[0], allowed(term))
            for char in term.removesuffix(WHOLE):
                if char not in below[at]:
                    below[at][char] = len(below)
                    below.append({})
                    most.append(0)
                at = below[at][char]
                most[at] = max(most[at], allowed(term))
            ends.setdefault(at, []).append(i)
            if not term.endswith(WHOLE):
                lasting.add(at)
        symbols = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t.removesuffix(WHOLE)}))}

        def closed(places: dict[int, int]) -> frozenset:
            todo = list(places.items())
            while todo:
                node, edits = todo.pop()
                for child in below[node].values():
                    if edits < most[child] and edits + 1 < places.get(child, 9):
                        places[child] = edits + 1
                        todo.append((child, edits + 1))
            return frozenset(places.items())

        def moved(state: frozenset, char: str | None) -> frozenset:
            places: dict[int, int] = {}

            def reach(node: int, edits: int) -> None:
                if edits <= most[node] and edits < places.get(node, 9):
                    places[node] = edits

            for node, edits in state:
                # a stem, once there, stays; otherwise the letter is one too many
                reach(node, edits if node in lasting else edits + 1)
                for c, child in below[node].items():
                    reach(child, edits if c == char else edits + 1)
            return closed(places)

        start = closed({0: 0})
        states: dict[frozenset, int] = {frozenset(): 0, start: 1}
        order, rows = [frozenset(), start], []
        by_symbol = [None, *sorted(symbols)]
        for state in order:
            row = []
            for char in by_symbol:
                after = moved(state, char)
                if after not in states:
                    states[after] = len(order)
                    order.append(after)
                row.append(states[after])
            rows.append(row)
        shape = len(order)
        term, stem = np.full(shape, -1, dtype=np.int32), np.full(shape, -1, dtype=np.int32)
        distance, stem_distance = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=np.int32)
        for at, state in enumerate(order):
            found = [(e, i) for n, e in state for i in ends.get(n, ()) if e <= allowed(terms[i])]
            if found:
                distance[at], term[at] = min(found)
            found = [f for f in found if not terms[f[1]].endswith(WHOLE)]
            if found:
                stem_distance[at], stem[at] = min(found)
        return Automaton(terms, symbols, np.array(rows, dtype=np.int32), term, distance, stem, stem_distance)

    def symbol_table(self) -> np.ndarray:
        table = np.zeros(0x110000, dtype=np.uint8)
        for char, i in self.symbols.items():
            table[ord(char)] = i
        return table


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of letters."""
    inside = np.concatenate(([False], letters()[points], [False]))
    border = np.flatnonzero(inside[1:] != inside[:-1])
    return border[::2], border[1::2] - border[::2]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether what surrounds a match speaks for a quotation rather than for abuse."""
    left, right = text[max(0, start - AROUND):start], text[end:end + AROUND]
    left, right = left[left.rfind("\n") + 1:], right.split("\n", 1)[0]
    marks = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
    around = f"{left} {right}"
    return 2 * marks + bool(_REPORT.search(around)) - 2 * bool(_ADDRESS.search(around)) > 0


Kind = tuple[int, int, bool]


class Matcher:
    """Runs an automaton over texts."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.table = automaton, automaton.symbol_table()
        sizes = [len(t.removesuffix(WHOLE)) for t in automaton.terms]
        self.least, self.most = min(sizes) - 1, max(sizes) + 1

    def kinds(self, batch: list[str | None]) -> list[set[Kind]]:
        """For each text its matches as (term, distance, whether quoted)."""
        lowered = [(t or "").lower() for t in batch]
        begin = np.cumsum([0, *[len(t) + 1 for t in lowered]])
        points = code_points("\n".join(lowered))
        start, length = words_of(points)
        fits = length >= self.least
        start, length = start[fits], length[fits]
        symbols, own = self.table[points], self.automaton
        found: list[set[Kind]] = [set() for _ in batch]

        def note(words: np.ndarray, terms: np.ndarray, distances: np.ndarray) -> None:
            hit = terms >= 0
            for word, term, distance in zip(words[hit].tolist(), terms[hit].tolist(), distances[hit].tolist()):
                first = int(start[word])
                i = int(np.searchsorted(begin, first, side="right")) - 1
                inside = first - int(begin[i])
                found[i].add((term, distance, quoted(lowered[i], inside, inside + int(length[word]))))

        alive, state = np.arange(len(start)), np.ones(len(start), dtype=np.int32)
        for j in range(self.most + 1):
            done = length[alive] == j
            note(alive[done], own.term[state[done]], own.distance[state[done]])
            alive, state = alive[~done], state[~done]
            if j == self.most or not len(alive):
                break
            state = own.step[state, symbols[start[alive] + j]]
            live = state > 0
            alive, state = alive[live], state[live]
        note(alive, own.stem[state], own.stem_distance[state])
        return found


# --- model -------------------------------------------------------------------


@dataclass(frozen=True)
class Toxicity:
    automaton: Automaton | None
    shares: dict[Kind, float]
    pooled: dict[tuple[int, bool], float]
    otherwise: float

    def score_of(self, kinds: set[Kind]) -> float:
        return max((self.shares.get(k, self.pooled.get(k[1:], 0.0)) for k in kinds), default=self.otherwise)

    def score(self, text: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            works_for("toxicity")
            if model.automaton is None:
                return pa.array([model.otherwise] * len(column), pa.float64())
            matcher = Matcher(model.automaton)
            return pa.array([model.score_of(k) for _, part in texts(column) for k in matcher.kinds(part)], pa.float64())

        return scored(text)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[int]] = {}

    def counts() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array([c[1] for c in held.values()]), pa.array([c[0] for c in held.values()])],
            ["word", "bad", "good"],
        )
        held.clear()
        return batch

    for column, toxic in arrays(batches, "text", "toxic"):
        for t, label in zip(column.to_pylist(), toxic.to_pylist()):
            for word in features(t.lower()):
                held.setdefault(word, [0, 0])[label] += 1
            if len(held) >= HELD_WORDS:
                yield counts()
    if held:
        yield counts()


def _covering(bad: DataFrame, candidates: dict[str, float], least: float) -> tuple[str, ...]:
    """Candidates that cover the toxic texts, the one with most texts not yet fully covered first.

    Clean texts that hold a term (the number given) count against it; of equal ones whole
    words go before stems and long terms before short ones. Of terms that begin alike to the
    end of one of them, only the first chosen stays.
    """
    wanted = set(candidates)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (column,) in arrays(batches, "text"):
            found = [sorted(features(t.lower()) & wanted) for t in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["terms"])

    texts_of: dict[str, set[int]] = {w: set() for w in candidates}
    for i, row in enumerate(bad.select("text").mapInArrow(held, "terms array<string>").collect()):
        for word in row["terms"]:
            texts_of[word].add(i)
    chosen: list[str] = []
    times: dict[int, int] = {}
    while texts_of:
        word = max(texts_of, key=lambda w: (len(texts_of[w]) - candidates[w], w.endswith(WHOLE), len(w), w))
        covered = texts_of.pop(word)
        if len(covered) < least:
            break
        chosen.append(word)
        core = word.removesuffix(WHOLE)
        for other in [w for w in texts_of if core.startswith(w.removesuffix(WHOLE)) or w.startswith(core)]:
            del texts_of[other]
        for i in covered:
            times[i] = times.get(i, 0) + 1
        full = {i for i in covered if times[i] >= COVER}
        for own in texts_of.values():
            own -= full
    return tuple(sorted(chosen))


def fit(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", *,
    sample: int = 4_000, lift: float = 40.0, support: float = 0.01,
) -> Toxicity:
    """Learns lexicon and shares from labelled rows.

    A term must be in ``support`` of the toxic texts drawn, and in three at least, and be
    ``lift`` times as frequent in them as in clean ones.
    """
    labelled = labels.select(F.col(key).alias("k"), F.col(toxic).cast("int").alias("y")).where(
        "k is not null and y in (0, 1)"
    ).groupBy("k").agg(F.max("y").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Toxicity(None, {}, {}, 1.0 if 1 in total else 0.0)
    share = F.when(F.col("toxic") == 1, share_of(total[1], sample)).otherwise(share_of(total[0], sample))
    chosen = labelled.where(drawn(share, "k"))
    rows = (
        documents.select(F.col(key).alias("k"), F.col(text).alias("text")).where("text is not null")
        .join(F.broadcast(chosen), "k").groupBy("text").agg(F.max("toxic").alias("toxic"))
    )
    rows = write_through(rows, "toxicity-sample")
    base = total[1] / (total[0] + total[1])
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if max(size.values(), default=0) > 2 * sample:
        share = F.when(F.col("toxic") == 1, share_of(size.get(1, 0), sample)).otherwise(share_of(size.get(0, 0), sample))
        rows = write_through(rows.where(drawn(share, "text")), "toxicity-thinned")
        size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    terms = (
        rows.mapInArrow(_word_counts, "word string, bad long, good long")
        .groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= max(3, support * bad))
        .where(F.col("bad") / max(bad, 1) >= lift * (F.col("good") + 0.5) / max(good, 1))
    )
    # a drawn text stands for as many labelled ones as its class has been thinned
    weight = {1: total[1] / max(bad, 1), 0: total[0] / max(good, 1)}
    against = weight[0] / weight[1]
    words = _covering(
        rows.where("toxic = 1"), {r["word"]: r["good"] * against for r in terms.collect()}, max(3, support * bad),
    )
    if not words:
        return Toxicity(None, {}, {}, base)
    automaton = Automaton.of(words)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(automaton)
        seen: dict[tuple, list[int]] = {}
        for column, toxic_ in arrays(batches, "text", "toxic"):
            for at, part in texts(column):
                for found, label in zip(matcher.kinds(part), toxic_.slice(at, len(part)).to_pylist()):
                    pools = {(-1, d, q) for _, d, q in found}
                    for kind in found | pools | (set() if found else {(-1, -1, False)}):
                        seen.setdefault(kind, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()),
            pa.array([k[2] for k in seen], pa.bool_()),
            pa.array([c[1] for c in seen.values()], pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64()),
        ], ["term", "distance", "quoted", "bad", "good"])

    counted = rows.mapInArrow(kinds, "term int, distance int, quoted boolean, bad long, good long").groupBy(
        "term", "distance", "quoted"
    ).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    scale = (bad + good) / (weight[1] * bad + weight[0] * good)
    seen = {
        (r["term"], r["distance"], r["quoted"]): (r["bad"] * weight[1] * scale, r["good"] * weight[0] * scale)
        for r in counted
    }
    pooled = {}
    for at, prior in PRIOR.items():
        b, g = seen.get((-1, *at), (0, 0))
        pooled[at] = (b + TRUST * prior) / (b + g + TRUST)
    shares = {
        k: (b + TRUST * pooled[k[1:]]) / (b + g + TRUST) for k, (b, g) in seen.items() if k[0] >= 0
    }
    b, g = seen.get((-1, -1, False), (0, 0))
    return Toxicity(automaton, shares, pooled, (b + TRUST * 0.5 * base) / (b + g + TRUST))


def clean(df: DataFrame, model: Toxicity, text: str = "text", *, most: float = 0.5) -> DataFrame:
    """Rows that score below ``most``; columns stay as they are."""
    score = fresh("toxicity")
    return df.withColumn(score, model.score(F.col(text))).where(F.col(score) < most).select(*df.columns)
