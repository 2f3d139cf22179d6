"""Toxicity by a weighted finite-state pattern grammar.

Words are read by letter automata and become symbols, some with a weight: insults (learned words and stems), threats,
targets, negation and reported speech. Five small transducers are composed over these symbols: insults and threats give
weights, negation marks what follows within three words, reported speech marks what is told as another's words, and the
target's transducer weighs unmarked insults more, and lets threats count only, where a target stands in the clause. The
composed machine runs over clauses, so what counts is a matched clause, not a word by itself. A text's sum is mapped to a
probability.

The insult lexicon and the map to probabilities are learned from at most ``SAMPLE_ROWS`` labelled rows outside the
held-out fold, those of least hash of doc_id; of copies and near copies among them (equal least shingle hash and label)
the one of least doc_id, then least text, counts. Everything else is done to whole texts of all rows.

Defined cases: null and empty texts get the score of a text without matches; very long texts are read whole, and long sums
count as ``MOST_TOTAL`` in learning only; an empty table gives no rows; of several labels of a doc_id the greatest counts;
a score of one half counts as toxic; without any labelled rows (or only one
label) the lexicon is the fixed one, with its default weight; repeated rows get equal scores; rows without doc_id are
scored, are outside the held-out fold and are never learned from; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.functions.session import cut

from .common import filter_rows, id_and_text
from .neardup import shingles

SAMPLE_ROWS = 20_000
FOLDS = 5
STEM_LENGTHS = (4, 5, 6)
#: A learned entry occurs in so large a share of toxic texts at least, and in so many.
LEAST_SHARE, LEAST_TEXTS = 0.004, 6
#: ... and so much more often (log ratio of smoothed document frequencies) than in others.
LEAST_LOG_RATIO = 3.0
DEFAULT_WEIGHT = 4.0
MOST_WEIGHT = 6.0
#: Sums above this are as good as it: the curve is fitted to sums rounded to tenths, so to few rows at any size.
MOST_TOTAL = 99.0

# Small closed word lists of the grammar.
INSULTS = "idiot moron stupid imbecile scum loser pathetic worthless disgusting trash clown dumbass bastard dummkopf trottel arschloch idiota imbécile connard crétin estúpido cabrón"
THREATS = "kill hurt destroy beat punish shoot stab umbringen verletzen töten tuer frapper matar golpear"
TARGETS = "you your yours he she they them him her du dich dir ihr euch sie tu te toi vous il elle tú usted ellos ella"
NEGATIONS = "not no never neither nicht kein keine nie pas jamais non nunca jamás"
REPORTS = "said says told claimed quoted reported wrote sagte sagt schrieb dit disait écrit dijo dice escribió"

SYMBOLS = range(10)
O, INSULT, THREAT, TARGET, NEGATION, REPORT, DENIED, TOLD, DENIED_THREAT, TOLD_THREAT = SYMBOLS
CLAUSE_END = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"\w+")


class Transducer:
    """A deterministic weighted transducer over small integer symbols; an arc is (next state, output, factor)."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int, float]], start: int = 0):
        self.arcs, self.start = arcs, start

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def then(self, other: Transducer, symbols: range = SYMBOLS) -> Transducer:
        """The composition: this one's output is the other's input; factors multiply."""
        number, todo, arcs = {(self.start, other.start): 0}, [(self.start, other.start)], {}
        while todo:
            pair = todo.pop()
            for symbol in symbols:
                mine, middle, a = self.step(pair[0], symbol)
                theirs, out, b = other.step(pair[1], middle)
                if (mine, theirs) not in number:
                    number[mine, theirs] = len(number)
                    todo.append((mine, theirs))
                arcs[number[pair], symbol] = (number[mine, theirs], out, a * b)
        return Transducer(arcs)


@functools.cache
def grammar() -> Transducer:
    """Insult, threat, negation, reported speech and target, composed."""
    insult = Transducer({(0, INSULT): (0, INSULT, 1.0)})
    threat = Transducer({(0, THREAT): (0, THREAT, 0.5)})
    scope = 3
    negation = {(s, NEGATION): (scope, NEGATION, 0.0) for s in range(scope + 1)}
    for s in range(1, scope + 1):
        negation |= {(s, x): (s - 1, x, 1.0) for x in (O, TARGET, REPORT)}
        negation |= {(s, INSULT): (s - 1, DENIED, 0.5), (s, THREAT): (s - 1, DENIED_THREAT, 0.5)}
    report = {(0, REPORT): (1, REPORT, 0.0), (1, INSULT): (1, TOLD, 0.75), (1, THREAT): (1, TOLD_THREAT, 0.75)}
    # States of the target's transducer: 0 no target, 1 a target stands in the clause.
    target = {(s, TARGET): (1, TARGET, 0.0) for s in range(2)}
    target |= {(0, threat): (0, threat, 0.0) for threat in (THREAT, DENIED_THREAT, TOLD_THREAT)} | {(1, INSULT): (1, INSULT, 1.25)}
    return insult.then(threat).then(Transducer(negation)).then(Transducer(report)).then(Transducer(target))


class LetterAutomaton:
    """Words and stems (beginnings of words) as a tree of letters; reading a word gives its symbol and weight."""

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, tuple[int, float]]):
        self.root: dict = {}
        for at, entries in (("whole", words), ("stem", stems)):
            for entry, output in entries.items():
                node = self.root
                for letter in entry:
                    node = node.setdefault(letter, {})
                node[at] = max(output, node.get(at, output), key=lambda x: x[1])

    def read(self, word: str) -> tuple[int, float]:
        node, best = self.root, (O, 0.0)
        for letter in word:
            node = node.get(letter)
            if node is None:
                return best
            best = max(best, node.get("stem", best), key=lambda x: x[1])
        whole = node.get("whole", best)
        return whole if whole[1] >= best[1] else best


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of whole words and of stems (beginnings of words), and the map from a sum to a probability."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 1.0
    offset: float = -2.0
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __reduce__(self):
        return ToxicityModel, (self.words, self.stems, self.slope, self.offset)

    def _compiled(self):
        if not self.cache:
            import ahocorasick

            found = ahocorasick.Automaton()
            threats = dict.fromkeys(THREATS.split(), (THREAT, DEFAULT_WEIGHT))
            for entry in {*self.words, *self.stems, *threats}:
                found.add_word(entry, len(entry))
            found.make_automaton()
            closed = {w: (kind, 0.0) for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words.split()}
            insults = [{w: (INSULT, x) for w, x in entries.items() if x > 0} for entries in (self.words, self.stems)]
            # What is known as an insult is read as one, whatever else it may be.
            self.cache.update(found=found, insults=LetterAutomaton(*insults), others=LetterAutomaton(threats | closed, {}), arcs=grammar())
        return self.cache["found"], self.cache["arcs"]

    def symbol(self, word: str) -> tuple[int, float]:
        insult = self.cache["insults"].read(word)
        if insult[0] != O:
            return insult
        return self.cache["others"].read(word)

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of each clause of the lower-cased text that the grammar matches."""
        found, arcs = self._compiled()
        hits = sorted({end + 1 - size for end, size in found.iter(text) if end == size - 1 or not text[end - size].isalnum()})
        if not hits:
            return []
        out, lo = [], 0
        for cut_at in (*((m.start(), m.end()) for m in CLAUSE_END.finditer(text)), (len(text), len(text))):
            first = bisect.bisect_left(hits, lo)
            if first < len(hits) and hits[first] < cut_at[0]:
                state, total = arcs.start, 0.0
                read = [self.symbol(word) for word in WORD.findall(text, lo, cut_at[0])]
                # A target counts for all of its clause, so the clause is read as if it began with it.
                if any(kind == TARGET for kind, _ in read):
                    state = arcs.step(state, TARGET)[0]
                for kind, weight in read:
                    state, _, factor = arcs.step(state, kind)
                    total += factor * weight
                if total:
                    out.append((lo, cut_at[0], total))
            lo = cut_at[1]
        return out

    def total(self, text: str) -> float:
        return sum(weight for *_, weight in self.clauses(text.lower()))

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * self.total(text) + self.offset))))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def entries_of(text: str) -> set[tuple[bool, str]]:
    """(is a stem, entry) for the words of a text."""
    words = {w for w in WORD.findall(text.lower()) if len(w) >= 3 and not w[0].isdigit()}
    return {(False, w) for w in words} | {(True, w[:n]) for w in words for n in STEM_LENGTHS if len(w) > n}


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit lexicon and map on the bounded sample. Counts are made on the executors.

    A learned entry is in a ``LEAST_SHARE``-th of the sample's toxic texts, so no more of them come back than
    ``1 / LEAST_SHARE`` times the entries of a text.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = id_and_text(docs).join(F.broadcast(chosen), "doc_id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(s.view(np.int64)[0]) if len(s) else 0 for s in map(shingles, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), *batch.columns], names=["least", "doc_id", "text", "toxic"])

    first = F.min(F.struct("doc_id", "text"))["text"]
    sample = cut(sample.mapInArrow(keyed, "least long, doc_id long, text string, toxic int").groupBy("least", "toxic").agg(first.alias("text")).select("text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    fixed = dict.fromkeys(INSULTS.split(), DEFAULT_WEIGHT)
    if not toxic or not clean:
        return ToxicityModel(fixed, {}, 1.0, -DEFAULT_WEIGHT / 2)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few rows at a time: a text has several entries for each of its words.
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            bad, good = Counter(), Counter()
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (bad if label == 1 else good).update(entries_of(text))
            both = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in both], pa.bool_()), pa.array([x[1] for x in both]), pa.array([bad[x] for x in both], pa.int64()), pa.array([good[x] for x in both], pa.int64())],
                names=["stem", "entry", "bad", "good"],
            )

    counts = sample.select("text", "toxic").mapInArrow(counted, "stem boolean, entry string, bad long, good long").groupBy("stem", "entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    top = counts.where(F.col("bad") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_LOG_RATIO)
    rows = top.collect()
    # A fixed insult that the sample knows as harmless leaves; others keep the default weight until they are learned.
    harmless = {r["entry"] for r in counts.where(~F.col("stem") & F.col("entry").isin(*fixed) & (F.col("good") * toxic > F.col("bad") * clean)).select("entry").collect()}
    words = {w: x for w, x in fixed.items() if w not in harmless} | {r["entry"]: min(MOST_WEIGHT, r["ratio"]) for r in rows if not r["stem"]}
    stems = {r["entry"]: min(MOST_WEIGHT, r["ratio"]) for r in rows if r["stem"]}
    model = ToxicityModel(words, stems)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(model.total(t), 1) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["total", "toxic"])

    seen = sample.mapInArrow(totals, "total double, toxic int").groupBy(F.least("total", F.lit(MOST_TOTAL)).alias("total"), "toxic").agg(F.count("*").alias("n")).collect()
    slope, offset = fit(np.array([(r["total"], float(r["toxic"] == 1), r["n"]) for r in sorted(seen)]))
    return ToxicityModel(words, stems, slope, offset)


def fit(rows: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (total, label, count), by Newton steps with a ridge on the slope."""
    x, y, n = rows.T
    slope, offset = 0.1, -1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([(n * (y - p) * x).sum() - ridge * slope, (n * (y - p)).sum() - 1e-3 * offset])
        hessian = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        change = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        slope, offset = max(0.05, slope + change[0]), offset + change[1]
        if np.abs(change).max() < 1e-9:
            break
    return float(slope), float(min(offset, -0.1))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows whose score is below one half, with their columns."""
    return filter_rows(docs, lambda text: model.score(text) < 0.5)
