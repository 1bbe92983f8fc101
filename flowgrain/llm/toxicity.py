"""Toxic documents by weak supervision.

Method. Many voters look at a document: lexicons of words and of word beginnings that stand
out in the labelled toxic texts, and patterns of tone. A generative label model explains
their votes by a hidden class: each voter's accuracy in either class, and the correlations
of voters as a tree of conditional dependencies, fitted by expectation maximisation over the
counts of all vote patterns in all documents, with the classes of labelled rows as known. Its
posterior labels train a linear classifier over the lexicon terms and the votes, which gives
the scores.

Size. The lexicons are learned from at most ``LABELLED`` labelled rows, lowest hash first;
all labels go into the label model. Vote patterns are sums over all documents; there are at
most 2^VOTERS patterns whatever the input, and at most ``TERMS`` terms, so the model on the
driver is bounded. The classifier is fitted on the posterior labels of at most ``SAMPLE``
documents of each class, lowest hash first. One pass reads the texts for the votes; scores
are computed from its small table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release, shielded, store, text_of

#: Most labelled rows the lexicons are learned from, and most terms in them; documents of each
#: class that the classifier is fitted on.
LABELLED, TERMS, SAMPLE = 40_000, 3000, 8000
#: Different contexts, and share of the toxic texts, that a term needs; letters of a beginning.
SUPPORT, SHARE, BEGINNING = 4, 0.001, 4
#: Lexicons of words and of beginnings; a word is a run of letters.
WORD_LEXICONS, BEGINNING_LEXICONS = 6, 3
NOT_WORD = r"[^\p{L}]+"
_WORD = re.compile(r"[^\W\d_]+")
#: Patterns of tone.
PATTERNS = (re.compile(r"!{2,}|\?!"), re.compile(r"(?:\b[A-Z]{3,}\b\W+){3,}"), re.compile(r"[A-Za-z][*@#$]+[A-Za-z]"),
            re.compile(r"\b(?:you|your|tu|toi|du|dich|vous|usted|ihr|euch)\b", re.IGNORECASE))
VOTERS = WORD_LEXICONS + BEGINNING_LEXICONS + len(PATTERNS) + 2


def _tokens(text) -> object:
    return F.filter(F.split(F.lower(text_of(F.col(text))), NOT_WORD), lambda w: w != "")


def _terms(word):
    """A word, and its beginning if it is longer."""
    return F.when(F.length(word) > BEGINNING, F.array(word, F.concat(F.lit("^"), F.substring(word, 1, BEGINNING)))
                  ).otherwise(F.array(word))


def term_statistics(rows: DataFrame) -> tuple[list[tuple[str, int, int]], int, int, int]:
    """Of labelled ``rows`` (text, label): terms (term, toxic, clean) by strength of their
    link with toxic texts; toxic rows, clean rows, and how many terms were tested.

    A text counts a term once. Toxic texts are told apart by the word before the term (of
    several, the one of the lowest hash), so copies of one text are one piece of evidence.
    """
    toxic = rows.where("label = 1").select(F.xxhash64("text").alias("copy"), _tokens("text").alias("w"))
    before = F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))
    pairs = toxic.where(F.size("w") > 0).select("copy", F.explode(F.arrays_zip(F.col("w"), before.alias("before"))).alias("p"))
    seen = (pairs.select("copy", F.explode(_terms(F.col("p.w"))).alias("term"), F.xxhash64("p.before").alias("before"))
            .groupBy("copy", "term").agg(F.min("before").alias("before")).select("term", "before").distinct().groupBy("term").agg(F.count("*").alias("toxic")))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    candidates = store(seen.where(F.col("toxic") >= max(SUPPORT, SHARE * n1)))
    tested = candidates.count()
    clean = rows.where("label = 0").select(F.explode(F.array_distinct(F.flatten(F.transform(_tokens("text"), _terms)))).alias(
        "term"))
    against = clean.groupBy("term").agg(F.count("*").alias("clean")).join(candidates.select("term"), "term", "left_semi")
    both = candidates.join(against, "term", "left").select("term", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))
    # twice the log-likelihood ratio of a binomial test against the share of toxic texts
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = n1 / max(1, n1 + n0)
    mine = a / (a + b)
    gain = 2 * (a * F.log(mine / share) + F.when(b > 0, b * F.log((1 - mine) / (1 - share))).otherwise(0.0))
    strong = both.withColumn("gain", gain).where((mine > share) & (F.col("gain") > 2 * np.log(max(1, tested))))
    top = strong.orderBy(F.desc("gain"), "term").limit(TERMS).collect() if n1 and n0 else []
    release(candidates)
    return [(r.term, r.toxic, r.clean) for r in top], n1, n0, tested


@dataclass
class Voters:
    """Lexicons by term, and how a text votes."""
    terms: dict[str, int]  # number of each term
    lexicon: list[int]  # voter of each term

    @classmethod
    def of(cls, terms: list[str]) -> Voters:
        counts, lexicon = [0, 0], []
        for t in terms:
            kind = t.startswith("^")
            groups = BEGINNING_LEXICONS if kind else WORD_LEXICONS
            lexicon.append((WORD_LEXICONS if kind else 0) + counts[kind] % groups)
            counts[kind] += 1
        return cls({t: i for i, t in enumerate(terms)}, lexicon)

    def vote(self, text: str) -> tuple[int, list[int]]:
        """Bit mask of the voters that call the text toxic, and the numbers of its terms."""
        words = Counter(_WORD.findall(text.lower()))
        found, hits = set(), 0
        number = self.terms.get
        for w, n in words.items():
            i = number(w)
            if i is not None:
                found.add(i)
                hits += n
            if len(w) > BEGINNING and (i := number("^" + w[:BEGINNING])) is not None:
                found.add(i)
        mask = 0
        for i in found:
            mask |= 1 << self.lexicon[i]
        at = WORD_LEXICONS + BEGINNING_LEXICONS
        for j, p in enumerate(PATTERNS):
            if p.search(text):
                mask |= 1 << (at + j)
        at += len(PATTERNS)
        mask |= (hits > 1) << at | (hits * 100 > words.total() > 0) << (at + 1)
        return mask, sorted(found)


@dataclass
class LabelModel:
    """Class share, a tree over the voters, and their conditional probabilities."""
    share: float = 0.0
    parent: list[int] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 2)))  # voter, class, parent's vote

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of rows of votes (n, voters) 0/1."""
        out = np.full(len(votes), np.log(self.share) - np.log1p(-self.share))
        for j in self.order:
            above = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), int)
            p1, p0 = self.table[j, 1, above], self.table[j, 0, above]
            out += np.where(votes[:, j] == 1, np.log(p1 / p0), np.log((1 - p1) / (1 - p0)))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -40, 40)))

    def accuracies(self) -> list[tuple[float, float]]:
        """(fires on toxic, fires on clean) of each voter, over its parent's even votes."""
        return [(float(t[1].mean()), float(t[0].mean())) for t in self.table]

    def correlations(self) -> list[tuple[int, int]]:
        """Pairs of voters that depend on each other within a class."""
        return [(self.parent[j], j) for j in self.order if self.parent[j] >= 0]


def _tree(votes: np.ndarray, weight: np.ndarray, toxic: np.ndarray) -> tuple[list[int], list[int]]:
    """Parents and an order of the tree with the most mutual information given the class."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    for y in (toxic, 1 - toxic):
        w = weight * y
        total = w.sum()
        if total <= 0:
            continue
        both = (votes * w[:, None]).T @ votes / total
        one = np.diag(both)
        cells = [(both, one[:, None] * one[None, :]), (one[:, None] - both, one[:, None] * (1 - one[None, :])),
                 (one[None, :] - both, (1 - one[:, None]) * one[None, :]),
                 (1 - one[:, None] - one[None, :] + both, (1 - one[:, None]) * (1 - one[None, :]))]
        for joint, apart in cells:
            joint = np.clip(joint, 1e-12, 1)
            info += total / weight.sum() * joint * np.log(joint / np.clip(apart, 1e-12, 1))
    parent, order, inside = [-1] * m, [0], {0}
    while len(order) < m:
        i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda p: (info[p], -p[1], -p[0]))
        parent[j] = i
        order.append(j)
        inside.add(j)
    return parent, order


def fit_labels(counts: list[tuple[int, int | None, int]], voters: int = VOTERS, rounds: int = 30) -> LabelModel:
    """Label model from (mask, known class or None, documents). The tree is chosen anew in
    the first rounds; a pseudo-count keeps every probability off 0 and 1."""
    masks = np.array([c[0] for c in counts], np.int64)
    votes = (masks[:, None] >> np.arange(voters) & 1).astype(np.int64)
    weight = np.array([c[2] for c in counts], float)
    known = np.array([-1 if c[1] is None else c[1] for c in counts])
    lexical = votes[:, :WORD_LEXICONS + BEGINNING_LEXICONS].any(axis=1)
    toxic = np.where(known >= 0, known, np.where(lexical, 0.9, 0.02)).astype(float)
    model = LabelModel()
    for step in range(rounds):
        if step < 3:
            model.parent, model.order = _tree(votes, weight, toxic)
        model.share = float(np.clip((weight * toxic).sum() / max(1e-9, weight.sum()), 1e-6, 1 - 1e-6))
        model.table = np.zeros((voters, 2, 2))
        for j in range(voters):
            above = votes[:, model.parent[j]] if model.parent[j] >= 0 else np.zeros(len(votes), int)
            for y, w in ((0, weight * (1 - toxic)), (1, weight * toxic)):
                for v in (0, 1):
                    rows = above == v
                    # a quarter of a document says that a lexicon speaks for its class
                    guess = 0.5 if j >= WORD_LEXICONS + BEGINNING_LEXICONS else (0.02, 0.5)[y]
                    model.table[j, y, v] = ((w * votes[:, j])[rows].sum() + 0.25 * guess) / (w[rows].sum() + 0.25)
        model.table = np.clip(model.table, 1e-6, 1 - 1e-6)
        toxic = np.where(known >= 0, known, model.posterior(votes))
    return model


def fit_linear(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, size: int, decay: float = 0.02,
               rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression over sparse 0/1 ``rows`` by accelerated
    gradient steps, for soft targets."""
    flat = np.fromiter((i for r in rows for i in r), np.int64, sum(map(len, rows)))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, v = np.zeros(size), np.zeros(size)
    total = weight.sum()
    share = float(np.clip((weight * target).sum() / total, 1e-6, 1 - 1e-6))
    b = c = np.log(share / (1 - share))
    # curvature at most a quarter of the largest row
    pace = 4 / (max([len(r) for r in rows], default=0) + 1)
    for step in range(rounds):
        z = np.bincount(owner, weights=v[flat], minlength=len(rows)) + c
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / total
        slope = np.bincount(flat, weights=error[owner], minlength=size) + decay / total * v
        w_new, b_new = v - pace * slope, c - pace * error.sum()
        push = step / (step + 3)
        v, c = w_new + push * (w_new - w), b_new + push * (b_new - b)
        w, b = w_new, b_new
    return w, float(b)


@dataclass
class Model:
    """All that scoring needs; at most TERMS terms and 2^VOTERS patterns."""
    voters: Voters
    labels: LabelModel
    weights: np.ndarray
    intercept: float

    def score(self, mask: int, terms: list[int]) -> float:
        n = len(self.voters.terms)
        z = self.intercept + sum(self.weights[i] for i in terms) + sum(
            self.weights[n + j] for j in range(VOTERS) if mask >> j & 1)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def votes(docs: DataFrame, voters: Voters) -> DataFrame:
    """``docs`` (text, any others) without text, with mask and terms."""
    batches_of(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [voters.vote(t or "") for t in batch.column(len(rest)).cast(pa.large_string()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([m for m, _ in found], pa.int32()),
                 pa.array([t for _, t in found], pa.list_(pa.int32()))], [*rest, "mask", "terms"])

    return docs.select(*rest, "text").mapInArrow(run, f"{kinds}, mask int, terms array<int>")


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of ``docs`` (doc_id, text, any others), learned from ``labels``
    (doc_id, label, any others): 1 toxic, 0 not, anything else unknown.

    Null and empty texts get the score of a text without votes. Rows with a null doc_id have
    no label; rows with a repeated one share it. A doc_id with different labels has none.
    Without labels of both classes the lexicons are empty and the patterns alone vote.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    known = (labels.select("doc_id", "label").where("label in (0, 1)").groupBy("doc_id")
             .agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high")
             .select("doc_id", F.col("low").cast("int").alias("label")))
    texts = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    known = store(known)
    # at most LABELLED rows, so they are broadcast and no other text is moved
    chosen = store(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))
    labelled = store(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"))
    terms, _, _, _ = term_statistics(labelled)
    release(labelled, chosen)
    voters = Voters.of([t for t, _, _ in terms])
    seen = votes(texts.withColumn("h", F.xxhash64("doc_id", "text")), voters)
    # labels come after the texts have been left behind
    table = store(seen.join(known, "doc_id", "left"))
    counts = table.groupBy("mask", "label").agg(F.count("*").alias("n")).collect()  # at most 3 * 2^VOTERS
    model = LabelModel(0.5) if not counts else fit_labels([(r.mask, r.label, r.n) for r in counts])
    by_mask: dict[int, int] = Counter()
    for r in counts:
        by_mask[r.mask] += r.n
    masks = np.array(sorted(by_mask), np.int64)
    guess = dict(zip(masks.tolist(), model.posterior(masks[:, None] >> np.arange(VOTERS) & 1) if len(masks) else [],
                     strict=True))
    toxic_masks = [m for m, p in guess.items() if p >= 0.5]
    is_toxic = F.col("mask").isin(toxic_masks) if len(toxic_masks) <= 500 else F.array_contains(
        F.array(*[F.lit(m) for m in toxic_masks]), F.col("mask"))
    rows, target, weight = [], [], []
    sizes = {True: sum(by_mask[m] for m in toxic_masks)}
    sizes[False] = sum(by_mask.values()) - sizes[True]
    for side in (True, False):
        part = table.where(is_toxic if side else ~is_toxic).orderBy("h").limit(SAMPLE).select("mask", "terms").collect()
        for r in part:
            rows.append(list(r.terms) + [len(terms) + j for j in range(VOTERS) if r.mask >> j & 1])
            target.append(guess[r.mask])
            weight.append(sizes[side] / len(part))
    size = len(terms) + VOTERS
    weights, intercept = fit_linear(rows, np.array(target), np.array(weight), size) if rows else (np.zeros(size), 0.0)
    fitted = spark.sparkContext.broadcast(Model(voters, model, weights, intercept))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fitted.value.score(m, t) for m, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                                            strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(got, pa.float64())],
                                             ["doc_id", "h", "score"])

    return table.select("doc_id", "mask", "terms", "h").mapInArrow(run, f"doc_id {kind}, h long, score double")


def drop(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) that score below ``least``.

    Null and empty texts have no votes and stay, unless the model holds texts without votes
    for toxic. Rows equal in doc_id and text stay or go together. Empty tables stay empty.
    """
    inner = shielded(docs, "doc_id", "text")
    scored = fit_and_score(inner, labels)
    # found again by a hash of id and text, so that rows without an id find theirs
    rejected = scored.where(F.col("score") >= least).select("h").distinct()
    keyed = inner.withColumn("h", F.xxhash64("doc_id", text_of(F.col("text"))))
    return keyed.join(rejected, "h", "left_anti").select(*inner.columns).toDF(*docs.columns)
