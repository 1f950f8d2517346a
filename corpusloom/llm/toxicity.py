"""Toxicity by cumulative-link (proportional-odds) ordinal regression on words.

P(grade > k) = logistic(score - threshold_k): one weight per word, shared by the ordered
thresholds. The result is the expected grade. The model is fitted on a sample of labelled texts
whose size ``max_train`` bounds; all texts are scored whole.

Where labels only say toxic or not, a toxic text's grade is derived: 2 if it holds at
least ``severe`` different words that mark toxic texts, else 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import at_rest, cut, fresh, small_batches

_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: Bytes of a word's beginnings that are features of their own.
STEMS = (5,)


def words_of(text: bytes | None) -> set[bytes]:
    """Different words (runs of letters, digits and bytes beyond ASCII, A-Z lower-cased), and the beginnings of longer ones with a hyphen."""
    words = set((text or b"").lower().translate(_SPACES).split())
    return words.union(*({w[:n] + b"-" for w in words if len(w) > n} for n in STEMS))


@dataclass
class OrdinalModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def score(self, words: set[bytes]) -> float:
        w = self.weights
        return sum(w[x] for x in words if x in w)

    def exceed(self, score: float) -> list[float]:
        """P(grade > k) for each threshold k."""
        return [0.5 * (1 + math.tanh((score - t) / 2)) for t in self.thresholds]


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, features: int, grade_count: int, l2: float = 0.1, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood; rows: features present in each text."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(row))
    share = np.array([np.mean(grades > k) for k in range(grade_count - 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    # thresholds as a first one and logarithms of the gaps, so that they stay ordered
    p = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    inf = np.array([np.inf])
    for step in range(1, steps + 1):
        w, gaps = p[:features], np.exp(p[features + 1 :])
        theta = p[features] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(row, w[col], n)
        cuts = np.concatenate([-inf, theta, inf])
        over = 0.5 * (1 + np.tanh((s[:, None] - cuts[None, :]) / 2))  # P(grade >= k) at cut k
        above, below = over[np.arange(n), grades + 1], over[np.arange(n), grades]
        ds = 1 - above - below  # slope of the log-likelihood in the score
        like = np.maximum(below - above, 1e-12)
        g = np.zeros_like(p)
        g[:features] = np.bincount(col, ds[row], features) - l2 * w
        dt = np.zeros(grade_count - 1)  # slope in each threshold
        for k in range(grade_count - 1):
            slope = over[:, k + 1] * (1 - over[:, k + 1]) / like
            dt[k] = (slope * (grades == k)).sum() - (slope * (grades == k + 1)).sum()
        g[features] = dt.sum()
        g[features + 1 :] = np.cumsum(dt[::-1])[::-1][1:] * gaps
        g /= n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:features], p[features] + np.concatenate([[0.0], np.cumsum(np.exp(p[features + 1 :]))])


def sample_labelled(df: DataFrame, labels: DataFrame, max_train: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of at most ``max_train`` labelled rows, chosen by a hash of the id."""
    one = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("__label"))
    chosen = one.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_train)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return cut(rows.join(F.broadcast(chosen), "doc_id").select("text", F.col("__label").alias("label")))


def fit_toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 12_000, max_words: int = 5_000, min_texts: int = 4, min_z: float = 4.0, severe: int = 3
) -> OrdinalModel:
    """``label_col``: 0 for clean, 1 for toxic (grades 1 and 2 are derived), or grades 0, 1, 2, ... as they are.

    Words enter if ``min_texts`` sampled texts hold them and their share among toxic texts differs from
    that among clean ones by ``min_z`` standard errors; of these the ``max_words`` clearest. Without labels of both
    kinds the model is empty and rejects nothing.
    """
    small_batches(df.sparkSession)
    train = sample_labelled(df, labels, max_train, id_col, text_col, label_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of[y > 0].update(words_of(t))
            ws = list(of[0].keys() | of[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array([of[0][w] for w in ws], pa.int64()), pa.array([of[1][w] for w in ws], pa.int64())], names=["word", "clean", "toxic"])

    totals = {r["y"]: r["n"] for r in train.groupBy((F.col("label") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return OrdinalModel()
    words = train.mapInArrow(count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    pooled = F.expr(f"(c + t) / {clean + toxic}D")
    z = (F.col("t") / toxic - F.col("c") / clean) / F.sqrt(pooled * (1.0001 - pooled) * (1 / toxic + 1 / clean))
    top = words.filter(F.expr(f"c + t >= {min_texts}")).withColumn("z", z).filter(F.abs("z") >= min_z).orderBy(F.desc(F.abs("z")), "word").limit(max_words)
    marks = [(bytes(r["word"]), r["z"]) for r in top.select("word", "z").collect()]
    at = {w: i for i, (w, _) in enumerate(marks)}
    toxic_marks = {i for i, (_, s) in enumerate(marks) if s > 0}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(at[w] for w in words_of(t) if w in at) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1)], names=["found", "label"])

    rows = [(list(r["found"]), r["label"]) for r in train.mapInArrow(present, "found array<int>, label int").collect()]
    grades = np.array([y for _, y in rows], np.int64)
    if grades.max() == 1:
        grades = np.array([y * (1 + (sum(i in toxic_marks for i in f) >= severe)) for f, y in rows], np.int64)
    grades = np.unique(grades, return_inverse=True)[1]
    weights, thresholds = fit_ordinal([f for f, _ in rows], grades, len(marks), int(grades.max()) + 1)
    return OrdinalModel({w: float(weights[i]) for w, i in at.items() if abs(weights[i]) > 1e-3}, [float(t) for t in thresholds])


def score_toxicity(df: DataFrame, model: OrdinalModel, text_col: str = "text", cutoff: float = 0.5, ending: str = "", keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with __severity (expected grade), __p_toxic (P(grade > 0)), __grade (grades exceeded with at least even
    odds) and __rejected (names that take ``ending``).

    Null and empty texts have no word and the score 0. Texts are looked at as bytes, well-formed or not. Repeated rows get the same. An
    empty table gives an empty one. Columns may have any other name than these four.
    """
    made = [f"__{n}{ending}" for n in ("severity", "p_toxic", "grade", "rejected")]
    held = list(df.columns) if keep is None else keep
    # a text that goes back is sent once; else, or where it is no string, it goes along last
    own = text_col in held and df.schema[text_col].dataType.typeName() == "string"
    place = held.index(text_col) if own else len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                odds = [model.exceed(model.score(words_of(t.as_py()))) for t in part.column(place).cast(pa.large_binary())]
                new = [pa.array([float(sum(p)) for p in odds], pa.float64()), pa.array([p[0] if p else 0.0 for p in odds], pa.float64()), pa.array([sum(x >= 0.5 for x in p) for p in odds], pa.int32()), pa.array([bool(p and p[0] >= cutoff) for p in odds], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(held)], *new], names=[*part.schema.names[: len(held)], *made])
        at_rest()

    small_batches(df.sparkSession)
    columns = [F.col(f"`{c}`") for c in held]
    sent = df.select(*columns) if own else df.select(*columns, F.col(f"`{text_col}`").cast("string").alias(*fresh(df, "in")))
    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in held)
    return sent.mapInArrow(run, kept + ", ".join(f"`{n}` {t}" for n, t in zip(made, ("double", "double", "int", "boolean"), strict=True)))


def drop_toxic(df: DataFrame, model: OrdinalModel, **options) -> DataFrame:
    """The rows of ``df`` the model does not reject, in its own columns, whatever their names."""
    ending = ""
    while any(f"__{n}{ending}" in [c.lower() for c in df.columns] for n in ("severity", "p_toxic", "grade", "rejected")):
        ending += "_x"
    return score_toxicity(df, model, ending=ending, **options).filter(f"not __rejected{ending}").select(*[f"`{c}`" for c in df.columns])
