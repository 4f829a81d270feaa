"""Quality classifier by co-training of two views.

One view sees what a text says (hashed words and word pairs), the other what is known about the page (source, language, length and
layout figures). Both start from the labelled documents. In each round both score every document, and each hands its most confident
unlabelled documents, with the labels it gives them, to the training rows of the other. Then each view's score is calibrated on the labelled
documents by cross-fitting, and the calibrated log odds are added up.

Documents are turned into two short vectors by one pass of Spark; the rounds read those vectors. The driver fits on a bounded number of
rows: at most `labelled` rows with labels and 2 x `handed` pseudo-labels per view and round.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.llm.batches import groups, map_arrow, texts_of
from canasta.llm.words import Words
from canasta.operators.skew import cut

TEXT_SIZE = 256             # components of the text view
PAGE_SIZE = 32              # hashed components of source and language, before the layout figures
LABELLED = 20_000           # bound of the labelled rows that are fitted
ROUNDS = 3
HANDED = 500                # most confident documents per class that a view hands over in a round
PENALTY = 1.0
SEED = 13
PARSED = 1 << 20

_KINDS = np.array([0 if b in (32, *range(9, 14)) else 1 if chr(b).islower() and b < 128 else 2 if chr(b).isupper() and b < 128 else
                   3 if chr(b).isdigit() and b < 128 else 4 if b < 128 else 5 for b in range(256)], np.uint8)


def text_vectors(texts: list[bytes]) -> np.ndarray:
    """Signed hashed counts of the words' outer characters, endings and whole words; the square root damps, length 1."""
    out = np.zeros((len(texts), TEXT_SIZE), np.float32)
    for a, b in groups([len(t) for t in texts], PARSED):
        words = Words(texts[a:b])
        if not len(words.hash):
            continue
        raw = np.frombuffer(words.stream, np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(b - a), np.diff(words.first))
        ends = raw[words.end - 1] << np.uint64(8) | raw[np.maximum(words.end - 2, words.begin)]
        starts = raw[words.begin] << np.uint64(8) | raw[np.minimum(words.begin + 1, words.end - 1)]
        for kind, value in enumerate((words.hash, ends, starts)):
            h = (value + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            place = (h >> np.uint64(40)) % np.uint64(TEXT_SIZE)
            counts = np.bincount(row * TEXT_SIZE + place.astype(np.int64), minlength=(b - a) * TEXT_SIZE).reshape(b - a, -1)
            out[a:b] += counts
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def page_vectors(texts: list[bytes], sources: list, langs: list) -> np.ndarray:
    """Hashed source and language, and layout figures: length, share of each kind of character, line length, line repeats."""
    out = np.zeros((len(texts), PAGE_SIZE + 10), np.float32)
    for i, (t, source, lang) in enumerate(zip(texts, sources, langs)):
        out[i, zlib.crc32(f"s{source}".encode()) % PAGE_SIZE] += 1
        out[i, zlib.crc32(f"l{lang}".encode()) % PAGE_SIZE] += 1
        n = len(t)
        figures = out[i, PAGE_SIZE:]
        figures[0] = np.log1p(n) / 10
        if n:
            kinds = np.bincount(_KINDS[np.frombuffer(t, np.uint8)], minlength=6) / n
            lines = t.count(b"\n") + 1
            figures[1:7] = kinds * [5, 1, 5, 5, 5, 5]
            figures[7] = np.log1p(n / lines) / 10
            figures[8] = len(set(t.split(b"\n"))) / lines
            figures[9] = np.log1p(t.count(b" ") + 1) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Logistic regression with intercept (last) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient, hessian = ridge * beta, np.diag(ridge)
        for i in range(0, len(x), 4096):                   # in parts, to keep copies small
            part, w = x[i:i + 4096], weight[i:i + 4096]
            q = p[i:i + 4096]
            gradient = gradient + part.T @ (w * (q - y[i:i + 4096]))
            hessian = hessian + (part * (w * q * (1 - q) + 1e-9)[:, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def odds(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same sum."""
    n = np.bincount(y.astype(int), minlength=2)
    return np.where(y > 0, 0.5 * len(y) / max(n[1], 1), 0.5 * len(y) / max(n[0], 1))


@dataclass(frozen=True)
class QualityModel:
    text: np.ndarray
    page: np.ndarray
    text_scale: np.ndarray      # slope and intercept of the calibrated log odds
    page_scale: np.ndarray
    prior: float                # log odds of the labelled rows


def vectors(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text view, page view) of every row, written to the shared folder."""
    source = docs.select(F.col(key).alias("key"), F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        def lists(x: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), pa.float32()))

        for batch in batches:
            texts = texts_of(batch.column(1))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(text_vectors(texts)), lists(page_vectors(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()))],
                                                 ["key", "tv", "pv"])

    return cut(map_arrow(source, run, f"key {kind}, tv array<float>, pv array<float>"), "views")


def _dot(vector: str, beta: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(w)) for w in beta[:-1]])
    return F.aggregate(F.zip_with(F.col(vector), weights, lambda a, b: a * b), F.lit(float(beta[-1])), lambda s, v: s + v)


def _fetched(rows: DataFrame) -> dict:
    """A bounded number of rows on the driver, by key: the keys and each view as a matrix."""
    table = rows.dropDuplicates(["key"]).orderBy("key").toArrow()
    out = {"key": table.column("key").to_pylist()}
    for c in table.column_names[1:]:
        values = table.column(c).combine_chunks()
        out[c] = (values.flatten().to_numpy().reshape(len(values), -1) if pa.types.is_list(values.type) else values.to_numpy()) if len(values) else np.empty((0, 1))
    return out


def co_train(views: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS,
             handed: int = HANDED) -> QualityModel | None:
    """The two classifiers and their calibration; None if the labels do not hold both classes.

    Labels of one key that disagree, and null labels, are left out. Of more than `labelled` labelled keys those with the smallest hashes
    are fitted. In a round each view looks at all documents without label that have not been handed over yet.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
             .agg(F.min(label).cast("double").alias("y"), F.max(label).cast("double").alias("y2")).where(F.col("y") == F.col("y2")).drop("y2"))
    chosen = known.orderBy(F.xxhash64("key", F.lit(SEED)), "key").limit(labelled)
    seen = _fetched(views.join(F.broadcast(chosen), "key"))
    y = seen["y"].ravel()
    if len(set(y.tolist())) < 2:
        return None
    seen = {"tv": seen["tv"], "pv": seen["pv"]}
    own = {v: (x, y) for v, x in seen.items()}
    betas = {v: fit(x, t, balanced(t)) for v, (x, t) in own.items()}
    free = views.where(F.col("key").isNotNull()).join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    free = cut(free, "unlabelled")
    taken: list = []
    for _ in range(rounds):
        scored = free.select("key", "tv", "pv", *[_dot(v, betas[v]).alias(f"z_{v}") for v in betas])
        if taken:
            done = views.sparkSession.createDataFrame([(k,) for k in taken], views.select("key").schema)
            scored = scored.join(F.broadcast(done), "key", "left_anti")
        scored = cut(scored.select("key", *[f"z_{v}" for v in betas]), "scored")
        picks = {}
        for v in betas:
            for sign, value in ((F.desc, 1.0), (F.asc, 0.0)):
                sure = F.col(f"z_{v}") > 0 if value else F.col(f"z_{v}") < 0
                for r in scored.where(sure).orderBy(sign(f"z_{v}"), "key").limit(handed).collect():
                    picks.setdefault(r["key"], {})[v] = value
        if not picks:
            break
        wanted = views.sparkSession.createDataFrame([(k,) for k in picks], views.select("key").schema)
        found = _fetched(free.join(F.broadcast(wanted), "key"))
        for v, other in (("tv", "pv"), ("pv", "tv")):      # what the other view is sure of
            given = [i for i, k in enumerate(found["key"]) if other in picks[k]]
            if given:
                x, t = own[v]
                own[v] = (np.vstack([x, found[v][given]]), np.concatenate([t, [picks[found["key"][i]][other] for i in given]]))
        taken += list(picks)
        betas = {v: fit(x, t, balanced(t)) for v, (x, t) in own.items()}
    scales = {}
    for v in betas:                                          # cross-fitted log odds of the labelled rows
        fold = np.arange(len(y)) % 5
        z = np.zeros(len(y))
        x, t = own[v]
        for f in range(5):
            out = np.concatenate([fold == f, np.zeros(len(t) - len(y), bool)])
            ok = ~out if len(set(t[~out].tolist())) == 2 else np.ones(len(t), bool)
            z[fold == f] = odds(seen[v][fold == f], fit(x[ok], t[ok], balanced(t[ok])))
        scales[v] = fit(z[:, None], y, np.ones(len(y)), 1e-3)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    return QualityModel(betas["tv"], betas["pv"], scales["tv"], scales["pv"], float(np.log(share / (1 - share))))


def score(views: DataFrame, model: QualityModel | None, key: str = "doc_id") -> DataFrame:
    """(key, text_score, page_score, quality_score, good) for every row; without a model all scores are 0.5 and good is true."""
    if model is None:
        half = F.lit(0.5)
        return views.select(F.col("key").alias(key), half.alias("text_score"), half.alias("page_score"), half.alias("quality_score"), F.lit(True).alias("good"))
    probability = lambda z: 1 / (1 + F.exp(-z))
    z_text = _dot("tv", model.text) * float(model.text_scale[0]) + float(model.text_scale[1])
    z_page = _dot("pv", model.page) * float(model.page_scale[0]) + float(model.page_scale[1])
    both = views.select("key", z_text.alias("a"), z_page.alias("b"))
    return both.select(F.col("key").alias(key), probability(F.col("a")).alias("text_score"), probability(F.col("b")).alias("page_score"),
                       probability(F.col("a") + F.col("b") - model.prior).alias("quality_score"),
                       (F.col("a") + F.col("b") - model.prior > 0).alias("good"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores of every row of `docs` (doc_id, text, source, lang). Null texts are empty, null sources and languages values of their own;
    repeated rows are scored each by itself, rows without key too, though they are never learned from."""
    views = vectors(docs, key)
    return score(views, co_train(views, labels, key), key)
