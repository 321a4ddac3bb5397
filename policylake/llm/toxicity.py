"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexicon: insult, threat, target (a person addressed or spoken of), negation, reported speech, the
rest. Four transducers read a clause's symbols and are composed into one machine:

    negation   an insult or threat within a few words after a negation is written as negated,
    reported   one after a verb of saying or inside quotation marks is written as reported,
    target     one with a target a few words before or after it is written as aimed,
    weighing   turns what the others have written into weights.

A clause ends with its punctuation or its line. Negation holds for four words, a verb of saying to the end of its clause, quotation
marks to the closing one or the end of the line. A clause is read forward through the first three, and what they wrote is read backward through the last two, as a target may
stand on either side. The score of a document comes from its matched clauses, not from isolated words: from the heaviest
clause, the sum over clauses and their number, with coefficients fitted by logistic regression on labelled documents. The
lexicon is learned from labelled documents: beginnings of words, inflected forms and compounds with them, that toxic documents
have and others don't, weighted by their odds. A short fixed list starts it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that the lexicon and the coefficients are fitted on, at most.
LABELLED = 20_000
#: A beginning of words is learned from so many toxic documents at least, if it is so many times likelier there, and if its
#: G statistic is beyond what the best of as many useless beginnings would reach by so much.
LEARNED_LEAST, LEARNED_ODDS, LEARNED_MARGIN = 4, 12.0, 6.0
#: Letters of a learned beginning, and entries of the lexicon at most.
SHORTEST, LONGEST, LEXICON = 4, 10, 5_000

#: Fixed word lists of the grammar: English, German, French, Spanish.
INSULTS = "idiot moron stupid loser scum trash clown pathetic disgusting worthless imbecile fool dumb jerk creep filth vermin coward bastard ugly".split()
THREATS = "kill hurt destroy beat stab shoot burn crush attack punish strangle murder".split()
TARGETS = (
    "you your yours yourself he him his she her they them their these those everyone people "
    "du dich dir dein deine ihr euch euer er ihn ihm sie ihnen "
    "tu toi te ton ta tes vous votre il lui elle ils elles leur "
    "tú ti usted ustedes vosotros él ella ellos ellas"
).split()
NEGATIONS = (
    "not no never neither nor without hardly isn't aren't wasn't don't doesn't didn't won't can't cannot "
    "nicht kein keine keinen nie niemals ohne weder "
    "pas jamais aucun aucune sans "
    "nunca jamás ningún ninguna sin tampoco"
).split()
SAYING = (
    "said says say called calls call wrote writes claimed claims reported reports told tells quoted quote alleged alleges "
    "sagt sagte nennt nannte schreibt schrieb behauptet behauptete "
    "dit disait appelle appelait écrit prétend affirme "
    "dice dijo llama llamó escribe escribió afirma"
).split()

OTHER, INSULT, THREAT, TARGET, NEGATION, SAY, QUOTE = range(7)
_NEAR = 3
_CLAUSE = re.compile(r"[.!?;:]+(?:\s|$)|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
_MARKS = frozenset("\"“”«»")
_QUOTES = re.compile("[\"“”«»]")


class Transducer:
    """States, and for each state and symbol the next state and what is written; a symbol without an entry is written as it is."""

    def __init__(self, start, arcs):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs(state, symbol)


def _negation() -> Transducer:
    """State: words for which a negation still holds."""

    def arcs(state: int, s: tuple) -> tuple:
        kind, flags, weight = s
        if kind == NEGATION:
            return _NEAR + 1, s
        if kind in (INSULT, THREAT) and state:
            flags |= {"negated"}
        return max(0, state - 1), (kind, flags, weight)

    return Transducer(0, arcs)


def _reported() -> Transducer:
    """State: 0 plain, 1 after a verb of saying, 2 inside quotation marks, 3 both."""

    def arcs(state: int, s: tuple) -> tuple:
        kind, flags, weight = s
        if kind == SAY:
            return state | 1, s
        if kind == QUOTE:
            return state ^ 2, s
        if kind in (INSULT, THREAT) and state:
            flags |= {"reported"}
        return state, (kind, flags, weight)

    return Transducer(0, arcs)


def _target() -> Transducer:
    """State: words since the last target, up to a limit. What follows an insult is seen by reading the clause backwards too."""

    def arcs(state: int, s: tuple) -> tuple:
        kind, flags, weight = s
        if kind == TARGET:
            return _NEAR + 1, s
        if kind in (INSULT, THREAT) and state:
            flags |= {"aimed"}
        return max(0, state - 1), (kind, flags, weight)

    return Transducer(0, arcs)


#: Factors of the weighing transducer.
FACTORS = {"negated": 0.25, "reported": 0.4, "aimed": 1.5}
#: A threat counts only if it is aimed at someone.
THREAT_WEIGHT = 2.0


def _weighing() -> Transducer:
    """One state; writes the weight of an insult, or of a threat that is aimed, times the factors of its flags, else 0."""

    def arcs(state: int, s: tuple) -> tuple:
        kind, flags, weight = s
        if kind == INSULT or (kind == THREAT and "aimed" in flags):
            for flag in sorted(flags):
                weight *= FACTORS[flag]
            return state, weight
        return state, 0.0

    return Transducer(0, arcs)


def compose(*machines: Transducer) -> Transducer:
    """One machine that sends each symbol through all, in order."""

    def arcs(states: tuple, s: tuple) -> tuple:
        out = []
        for m, state in zip(machines, states):
            state, s = m.step(state, s)
            out.append(state)
        return tuple(out), s

    return Transducer(tuple(m.start for m in machines), arcs)


FORWARD = compose(_negation(), _reported(), _target())
BACKWARD = compose(_target(), _weighing())
#: The first three at the beginning of a clause that goes on with a quotation.
QUOTED = (FORWARD.start[0], 2, FORWARD.start[2])


@dataclass
class Grammar:
    """``insults``: weights of words. ``stems``: weights of beginnings of words; the longest that fits a word counts."""

    insults: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 1.5, 0.5, 0.5])
    _kinds: dict = field(default_factory=dict, repr=False)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"insults": self.insults, "stems": self.stems, "coefficients": self.coefficients, "_kinds": {}, "_automaton": None}

    def symbol(self, word: str) -> tuple:
        """(kind, flags, weight) of a lower-cased word or mark."""
        if not self._kinds:
            for kind, words, weight in ((TARGET, TARGETS, 0.0), (NEGATION, NEGATIONS, 0.0), (SAY, SAYING, 0.0), (QUOTE, _MARKS, 0.0), (THREAT, THREATS, THREAT_WEIGHT)):
                self._kinds.update(dict.fromkeys(words, (kind, frozenset(), weight)))
            self._kinds.update({w: (INSULT, frozenset(), weight) for w, weight in self.insults.items()})
        found = self._kinds.get(word)
        if found is None:
            stem = next((word[:n] for n in range(min(len(word), LONGEST), SHORTEST - 1, -1) if word[:n] in self.stems), None)
            found = (INSULT, frozenset(), self.stems[stem]) if stem else (OTHER, frozenset(), 0.0)
        return found

    def automaton(self):
        """Finds insults, threats and beginnings of words: a clause without one has no weight. Values: length, and whether a word ends there."""
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for w in {*self.insults, *THREATS}:
                made.add_word(w, (len(w), True))
            for w in self.stems:
                made.add_word(w, (len(w), False))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def clause_weight(self, clause: str, quoted: bool = False) -> float:
        """Weight of a lower-cased clause; ``quoted`` where it begins inside quotation marks."""
        state, read = QUOTED if quoted else FORWARD.start, []
        for w in _WORD.findall(clause):
            state, s = FORWARD.step(state, self.symbol(w))
            read.append(s)
        state, total = BACKWARD.start, 0.0
        for s in reversed(read):
            state, weight = BACKWARD.step(state, s)
            total += weight
        return total

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """(first, after last, weight) of the clauses that have a weight."""
        if not text:
            return []
        low = text.lower()
        hits = []
        for end, (size, whole) in self.automaton().iter(low):
            a, b = end - size + 1, end + 1
            if not (a and (low[a - 1].isalpha() or low[a - 1] == "'")) and not (whole and b < len(low) and low[b].isalpha()):
                hits.append(a)
        if not hits:
            return []
        out, done = [], -1
        edges = None
        for a in sorted(hits):
            if a < done:
                continue
            if edges is None:
                edges = [m.end() for m in _CLAUSE.finditer(low)]
                at = np.array(edges, np.int64)
            k = int(np.searchsorted(at, a, side="right"))
            first, done = (edges[k - 1] if k else 0), (edges[k] if k < len(edges) else len(low))
            # A quotation goes on from clause to clause, as far as its line.
            weight = self.clause_weight(low[first:done], len(_QUOTES.findall(low, low.rfind("\n", 0, first) + 1, first)) % 2 == 1)
            if weight:
                out.append((first, done, weight))
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The heaviest clause, the sum over clauses and their number, the latter two on a logarithmic scale."""
        found = [w for _, _, w in self.clauses(text)]
        return (max(found), float(np.log1p(sum(found))), float(np.log1p(len(found)))) if found else (0.0, 0.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, insults: dict[str, float] | None = None) -> Grammar:
    """A grammar fitted on at most ``labelled`` documents of ``labels``, those with the smallest hashes of their ids.

    ``insults``: the lexicon to start from, the fixed list if not given. Rows without an id or a label are passed over. Ids
    may have any type that both tables' ids can be cast to text from. Without labels the lists and coefficients stay."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(labelled).toPandas()  # bounded by ``labelled``
    grammar = Grammar(dict.fromkeys(INSULTS, 1.0) if insults is None else dict(insults))
    if not len(sample):
        return grammar
    ids = F.broadcast(docs.sparkSession.createDataFrame(sample, "_id string, _label int"))
    marked = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id")
    words = marked.select("_label", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("_text", F.lit(""))), "[^\\p{L}]+"))).alias("w"))
    counts = words.where(F.length("w") >= SHORTEST).groupBy("w").agg(F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("clean"))
    beginnings = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("w"), F.lit(LONGEST))), lambda n: F.substring("w", F.lit(1), n))
    stems = counts.select("toxic", "clean", F.explode(beginnings).alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n_toxic, n_clean = int((sample["_label"] == 1).sum()), int((sample["_label"] == 0).sum())
    odds = (F.col("toxic") + 0.5) / (n_toxic + 1.0) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    likely = (F.col("toxic") >= LEARNED_LEAST) & (odds >= LEARNED_ODDS)
    # Candidates, and the number of all beginnings in a row of its own.
    rows = stems.groupBy(F.when(likely, F.col("stem")).alias("stem")).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = rows.orderBy(F.col("stem").isNotNull(), F.desc("toxic"), "stem").limit(20 * LEXICON).collect()
    grammar.stems = _stems([r for r in got if r.stem is not None], sum(r.n for r in got), n_toxic, n_clean)
    # What was learned of a word counts, not the list.
    grammar.insults = {w: x for w, x in grammar.insults.items() if not any(w[:k] in grammar.stems for k in range(SHORTEST, LONGEST + 1))}
    got = _with_features(marked.select("_text", "_label"), grammar, "_text").select("_label", "heaviest", "total", "matched").toPandas()  # rows of the sample
    x = np.column_stack([np.ones(len(got)), got[["heaviest", "total", "matched"]].to_numpy(np.float64)])
    grammar.coefficients = _logistic(x, got["_label"].to_numpy(np.float64)).tolist()
    return grammar


def _stems(rows: list, n_stems: int, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the beginnings that labels set apart; one that goes on from a shorter one is left out."""
    base = n_toxic / max(1, n_toxic + n_clean)
    if not 0 < base < 1:
        return {}
    found, needed = {}, 2 * np.log(max(2, n_stems)) + LEARNED_MARGIN
    for r in sorted(rows, key=lambda r: (len(r.stem), -r.toxic, r.stem)):
        n = r.toxic + r.clean
        g = 2 * (r.toxic * np.log(r.toxic / (n * base)) + (r.clean * np.log(r.clean / (n * (1 - base))) if r.clean else 0.0))
        if g < needed or any(r.stem[:k] in found for k in range(SHORTEST, len(r.stem))):
            continue
        odds = (r.toxic + 0.5) / (n_toxic + 1.0) / ((r.clean + 0.5) / (n_clean + 1.0))
        found[r.stem] = float(np.clip(np.log(odds) / 3, 0.5, 2.5))
        if len(found) == LEXICON:
            break
    return found


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Coefficients by Newton's method with a ridge on all but the first."""
    b = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


_ADDED = T.StructType([T.StructField(c, T.DoubleType()) for c in ("heaviest", "total", "matched")])


def _with_features(df: DataFrame, grammar: Grammar, text_col: str) -> DataFrame:
    schema = T.StructType([*df.schema, *_ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1000):
                batch = whole.slice(i, 1000)
                got = [grammar.features(t.as_py()) for t in batch.column(text_col)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], names=schema.names)

    return df.mapInArrow(run, schema)


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with heaviest, total and matched (of their clauses), score (0 to 1) and predicted.

    Null and empty texts have no clause: the score of a text without any. Equal texts have equal scores; texts are read
    whole. An empty table gives an empty table. No column may have an added name."""
    added = [*_ADDED.names, "score", "predicted"]
    if clash := set(added) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    b = grammar.coefficients
    logit = F.lit(b[0]) + F.col("heaviest") * b[1] + F.col("total") * b[2] + F.col("matched") * b[3]
    return _with_features(docs, grammar, text_col).withColumn("score", 1 / (1 + F.exp(-logit))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
