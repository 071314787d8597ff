"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers run along a clause. One gives weight to insults, one to threats; others mark targets, negation
and reported speech. Composed, they give the clause a score: an insult or threat counts more at a target,
less under a negation and less where somebody is quoted. Weights of insults are learnt from labelled
documents, as words and as beginnings of words; a logistic curve turns clause scores into a document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmat.llm.frames import map_texts, text_or_empty
from kinmat.llm.tokens import WordMemory

#: Labelled documents that weights and curve are fitted on, at most; the bound on what is learnt from.
TRAINING_ROWS = 10_000
#: Terms that the lexicon holds at most, those with the most evidence; it is sent to every task.
LEXICON_TERMS = 20_000
#: Groups of like documents in which a learnt term must be labelled toxic, and its least weight less its error.
LEAST_GROUPS = 5
LEAST_WEIGHT = 1.5
#: Letters of the beginnings of words that may be learnt.
STEMS = range(4, 9)

# Common words of four languages with a part in the grammar.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown fool dumb bastard
    imbecile cretin idiotisch dumm dummkopf trottel versager abschaum arschloch widerlich erbärmlich imbécile stupide crétin
    débile ordure minable connard idiota estúpido estúpida imbécil basura escoria payaso asqueroso patético""".split()
THREATS = """kill kills killed murder hurt beat destroy stab shoot strangle umbringen töten ermorden schlagen erschießen
    tuer frapper égorger assassiner détruire matar golpear asesinar destruir apuñalar""".split()
TARGETS = """you your yours yourself he him she her they them du dich dir ihr euch sie ihn ihm tu te toi vous il elle ils elles
    tú ti usted ustedes él ella ellos ellas vosotros""".split()
NEGATIONS = """not no never nobody cannot nicht kein keine keinen nie niemals pas jamais aucun aucune ni nunca jamás
    tampoco ningún ninguna""".split()
REPORTS = """said says saying called calls wrote writes claimed claims reported quoted sagte sagt schrieb nannte behauptet
    zitiert dit disait écrit appelé affirme dijo dice escribió llamó afirma""".split()

#: Weight of a listed insult or threat of which no labelled document tells otherwise.
LISTED_WEIGHT = 2.5
#: How a clause's weight changes at a target, under a negation and in reported speech.
AT_TARGET, NEGATED, REPORTED = 1.2, 0.5, 0.7

_TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?\n|]")
_ENDS = frozenset(".,;:!?\n|")
_END, _TARGET, _NEGATION, _REPORT = -1.0, -2.0, -3.0, -4.0
FEATURES = ("total", "highest", "clauses", "words")


@dataclass(frozen=True)
class Grammar:
    """words and stems: learnt weights; curve: intercept and a factor for each feature."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (0.0,) * (len(FEATURES) + 1)

    def symbol(self, token: str) -> float:
        """What the lexical transducers write for a token: a weight above 0, a mark below, or 0."""
        if token in _ENDS:
            return _END
        known = self.words.get(token)
        if known is not None:
            return known
        for marks, value in _MARKS:
            if token in marks:
                return value
        for length in range(min(len(token), max(STEMS)), min(STEMS) - 1, -1):
            known = self.stems.get(token[:length])
            if known is not None:
                return known
        return 0.0


_MARKS = (
    (frozenset(INSULTS) | frozenset(THREATS), LISTED_WEIGHT),
    (frozenset(TARGETS), _TARGET),
    (frozenset(NEGATIONS), _NEGATION),
    (frozenset(REPORTS), _REPORT),
)


def clause_scores(symbols: list[float]) -> Iterable[tuple[float, int]]:
    """(score, matches) of every clause with a match.

    The state is the clause's weight so far with three marks; reading the end of a clause writes its score.
    """
    weight, matches, target, negated, reported = 0.0, 0, False, False, False
    for symbol in [*symbols, _END]:
        if symbol > 0:
            weight += symbol * (NEGATED if negated else 1.0)
            matches += 1
        elif symbol == _TARGET:
            target = True
        elif symbol == _NEGATION:
            negated = True
        elif symbol == _REPORT:
            reported = True
        elif symbol == _END:
            if matches:
                yield weight * (AT_TARGET if target else 1.0) * (REPORTED if reported else 1.0), matches
            weight, matches, target, negated, reported = 0.0, 0, False, False, False


def text_features(symbols: list[float]) -> tuple[float, float, float, float]:
    scores = list(clause_scores(symbols)) if symbols and max(symbols) > 0 else []
    total = sum(s for s, _ in scores)
    return (
        math.log1p(total),
        math.log1p(max((s for s, _ in scores), default=0.0)),
        math.log1p(len(scores)),
        math.log1p(sum(n for _, n in scores)),
    )


def features(docs: DataFrame, grammar: Grammar, keep: list[str] | None = None) -> DataFrame:
    """Add the four features of each whole text; a text without a matched clause has zeros."""

    def make():
        memory = WordMemory(grammar.symbol)

        def work(texts: list[str]) -> dict[str, Iterable]:
            rows = [text_features([memory[t] for t in _TOKEN.findall(text.lower())]) for text in texts]
            return dict(zip(FEATURES, zip(*rows)))

        return work

    return map_texts(docs, "text", make, pa.schema([(n, pa.float64()) for n in FEATURES]), keep)


def score(docs: DataFrame, grammar: Grammar, keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold``) of each whole text.

    Null and empty texts have the score of a text without a match. Other columns stay, repeated rows too;
    columns named score or predicted are replaced, those named like a feature left out.
    """
    measured = features(docs, grammar, keep)
    line = F.lit(float(grammar.curve[0]))
    for name, factor in zip(FEATURES, grammar.curve[1:]):
        line = line + F.col(name) * F.lit(float(factor))
    value = 1 / (1 + F.exp(-line))
    return (
        measured.withColumn("score", value)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .drop(*FEATURES)
    )


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAINING_ROWS) -> DataFrame:
    """text, toxic and part (0 or 1) of at most ``rows`` labelled documents, chosen by a hash of their ids.

    Only labels that are 0 or 1 and pass ``allowed``, a condition on doc_id, are read. Weights are learnt from part 0,
    the curve from part 1. If a document has several labels, all count.
    """
    chosen = (
        labels.where(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "toxic")
        .limit(rows)
    )
    # At most ``rows`` ids with their labels.
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0, 1).otherwise(0).alias("part")
    )


def _terms(rows: DataFrame) -> DataFrame:
    """(term, group) once for each document: its words, and its words' beginnings with a hyphen behind."""

    def make():
        from xxhash import xxh64_intdigest

        def work(texts: list[str]) -> dict[str, Iterable]:
            terms, groups = [], []
            for text in texts:
                tokens = [t for t in _TOKEN.findall(text.lower()) if t not in _ENDS]
                words = set(tokens)
                runs = {" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))}
                stems = {f"{w[:n]}-" for w in words for n in STEMS if len(w) >= n}
                terms.append([*words, *stems])
                groups.append(min(xxh64_intdigest(r) >> 1 for r in runs))
            return {"terms": terms, "group": groups}

        return work

    added = pa.schema([("terms", pa.list_(pa.string())), ("group", pa.int64())])
    found = map_texts(rows, "text", make, added, keep=[])
    return found.select(F.explode("terms").alias("term"), "group")


def learn_terms(rows: DataFrame, terms: int = LEXICON_TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and stems: log odds of a toxic label, counted in groups of like documents.

    Documents whose least hash of three words is the same are one group, so that copies do not vouch for each other. A weight
    must exceed its own error, too.
    """
    toxic, clean = _terms(rows.where("toxic = 1")), _terms(rows.where("toxic = 0"))
    groups = [side.agg(F.count_distinct("group").alias("n")).first()["n"] for side in (toxic, clean)]
    candidates = (
        toxic.groupBy("term").agg(F.count_distinct("group").alias("toxic")).where(F.col("toxic") >= LEAST_GROUPS)
    )
    # At most as many as the training documents have terms, over LEAST_GROUPS; Spark may broadcast them.
    against = clean.join(candidates.select("term"), "term", "left_semi").groupBy("term").agg(
        F.count_distinct("group").alias("clean")
    )
    pair = F.col("toxic") + 0.5, F.coalesce("clean", F.lit(0)) + 0.5
    weight = F.log(pair[0] / (groups[0] + 1)) - F.log(pair[1] / (groups[1] + 1))
    best = (
        candidates.join(against, "term", "left")
        .withColumn("weight", weight)
        .where(F.col("weight") - F.sqrt(1 / pair[0] + 1 / pair[1]) >= LEAST_WEIGHT)
        .orderBy((F.col("weight") * F.col("toxic")).desc(), "term")
        .limit(terms)
        .collect()
    )
    words = {r["term"]: r["weight"] for r in best if not r["term"].endswith("-")}
    return words, {r["term"][:-1]: r["weight"] for r in best if r["term"].endswith("-")}


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 30, penalty: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's steps; without both labels the curve is flat at the labels' share."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
        return (math.log(share / (1 - share)), *[0.0] * x.shape[1])
    rows = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(rows.shape[1])
    ridge = np.diag([1e-6, *[penalty] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (p - y) + ridge @ beta
        curvature = (rows * (p * (1 - p))[:, None]).T @ rows + ridge
        beta -= np.linalg.solve(curvature, slope)
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAINING_ROWS) -> Grammar:
    """Learn a grammar from labelled documents that pass ``allowed``; empty tables give one without learnt terms."""
    from kinmat.session import settle

    training = settle(training_rows(docs, labels, allowed, rows))
    words, stems = learn_terms(training.where("part = 0"))
    bare = Grammar(words, stems)
    measured = features(training.where("part = 1"), bare, keep=["toxic"]).collect()
    x = np.array([[r[n] for n in FEATURES] for r in measured], dtype=float).reshape(len(measured), len(FEATURES))
    return Grammar(words, stems, fit_curve(x, np.array([r["toxic"] for r in measured], dtype=float)))


def remainder(column: str = "doc_id") -> Column:
    """The quarter that an id belongs to."""
    return F.crc32(F.col(column).cast("string")) % 4
