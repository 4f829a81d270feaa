"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit separates the languages with that bit from those without. A classifier
is a table of log odds per hashed byte n-gram, learned from n-gram counts that Spark adds up over a bounded sample of labelled
rows. A text's margin for a bit is the mean of its n-grams' log odds; decoding takes the codeword with the least loss, each bit
weighted by how often its classifier is right on the sample, and flags texts whose two best codewords lie close together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.llm.batches import groups, map_arrow, texts_of
from canasta.operators.skew import cut

ORDERS = (2, 4)                 # lengths of the byte n-grams
BUCKETS = 1 << 16               # table size per length
ROWS_PER_LANGUAGE = 2000        # bound of the labelled sample
TEXT_BYTES = 1 << 20            # texts handled together in a task
SAMPLE_PARTS = 16
SEED = 7

_MAP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def codewords(n: int) -> np.ndarray:
    """One row of -1/+1 per language: all different splits up to five languages, else random ones that lie far apart."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1.0, -1.0)
    rng, best, apart = np.random.default_rng(SEED), None, -1
    for _ in range(200):
        code = np.where(rng.random((n, int(np.ceil(10 * np.log2(n))))) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(0)) < n]
        near = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9).min()
        if near > apart:
            best, apart = code, near
    return best


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each between two blanks at either side, and where each begins (one more entry for the end)."""
    joined = b"".join(b"  %b  " % t for t in texts)
    begins = np.cumsum([0] + [len(t) + 4 for t in texts])
    return _MAP[np.frombuffer(joined, np.uint8)], begins


def _buckets(stream: np.ndarray, order: int) -> np.ndarray:
    """Hash bucket of the n-gram that begins at each byte; runs of blanks get bucket 0."""
    n = len(stream) - order + 1
    gram = stream[:n].astype(np.uint32)
    for i in range(1, order):
        gram |= stream[i:i + n].astype(np.uint32) << np.uint32(8 * i)
    blank = np.uint32(0x20202020 & (1 << 8 * order) - 1)
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(16)
    bucket[gram == blank] = 0
    return bucket


def _lower(column: pa.Array) -> list[bytes]:
    return texts_of(pc.utf8_lower(column))


def _counts(batches):
    """Rows (lang, bucket of all tables, count) of one task's part of the sample."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = _lower(batch.column(1))
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            total = totals.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS, np.int64))
            for a, b in groups([len(t) for t in own], TEXT_BYTES):
                stream, _ = _stream(own[a:b])
                for k, order in enumerate(ORDERS):
                    total[k * BUCKETS:(k + 1) * BUCKETS] += np.bincount(_buckets(stream, order), minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                                         ["lang", "bucket", "n"])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray           # language x bit
    weights: np.ndarray        # (order x bucket) x bit, log odds
    scale: np.ndarray          # typical size of a margin, per bit
    trust: np.ndarray          # weight of each bit, sums to 1

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Text x bit: mean log odds of the n-grams."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for a, b in groups([len(t) for t in texts], TEXT_BYTES):
            stream, begins = _stream(texts[a:b])
            for k, order in enumerate(ORDERS):
                bucket = _buckets(stream, order)
                cuts = np.column_stack([begins[:-1], begins[1:] - order + 1]).ravel()
                cuts = cuts[:-1] if cuts[-1] >= len(bucket) else cuts
                counted = np.add.reduceat((bucket != 0).astype(np.int64), cuts)[::2]
                for bit in range(out.shape[1]):
                    table = self.weights[k * BUCKETS:(k + 1) * BUCKETS, bit]
                    out[a:b, bit] += np.add.reduceat(table[bucket], cuts)[::2] / np.maximum(counted, 1)
        return out

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Text x language: share of belief, from the weighted logistic loss of each codeword."""
        loss = np.logaddexp(0, -4 * (margins / self.scale)[:, None, :] * self.code[None]) @ self.trust
        belief = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        return belief / belief.sum(1, keepdims=True)


def train(rows: DataFrame, lang: str = "lang", text: str = "text", per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """A model from about `per_language` different texts of each language of `rows`, all of them where there are no more; whole texts.

    Rows without language or text are left out. Texts are chosen by their hash: a language's share of the hash range follows from its number of
    different texts, so copies count once and no language's rows meet in a task. Spark adds up the counts; the driver gets the finished weight
    tables only: 2 x 65,536 rows of one number per bit, whatever the size of the input.
    """
    names = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(F.col(text), F.lit(SEED)).alias("_u"))
    share = F.lit(float(per_language)) / F.count(F.lit(1))
    limit = F.when(share < 1, (-(2.0 ** 63) + share * 2.0 ** 64).cast("long"))
    limits = names.select("_lang", "_u").distinct().groupBy("_lang").agg(limit.alias("_limit"))       # a row per language
    chosen = names.join(F.broadcast(cut(limits, "language_limits")), "_lang").where(F.col("_limit").isNull() | (F.col("_u") < F.col("_limit")))
    sample = chosen.dropDuplicates(["_lang", "_u"]).select("_lang", "_text")
    sample = cut(sample.repartition(SAMPLE_PARTS), "language_sample")
    grams = map_arrow(sample, _counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    grams = cut(grams, "language_counts")
    totals = {(r["lang"], r["k"]): r["n"] for r in grams.groupBy("lang", F.expr(f"bucket div {BUCKETS}").alias("k")).agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted({x for x, _ in totals}, key=lambda x: x.encode("utf-8")))
    code = codewords(len(languages))
    weights = np.zeros((len(ORDERS) * BUCKETS, code.shape[1]), np.float32)
    if code.shape[1]:
        n = F.expr(f"bucket div {BUCKETS}")

        def log_share(side: np.ndarray) -> Column:
            members = [languages[i] for i in np.flatnonzero(side)]
            total = F.when(n == 0, sum(totals.get((x, 0), 0) for x in members)).otherwise(sum(totals.get((x, 1), 0) for x in members))
            inside = F.sum(F.when(F.col("lang").isin(members), F.col("n")).otherwise(0))
            return F.ln((inside + 0.5) / (F.max(total) + 0.5 * BUCKETS))

        odds = grams.groupBy("bucket").agg(F.array(*[log_share(code[:, b] > 0) - log_share(code[:, b] < 0) for b in range(code.shape[1])]).alias("w"))
        for r in odds.toLocalIterator():
            weights[r["bucket"]] = r["w"]
        for k in range(len(ORDERS)):
            weights[k * BUCKETS] = 0
    bits = code.shape[1]
    model = LanguageModel(languages, code, weights, np.ones(bits), np.ones(bits) / max(bits, 1))
    if not bits:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        for batch in batches:
            m = shared.value.margins(_lower(batch.column(1)))
            own = shared.value.code[[shared.value.languages.index(x) for x in batch.column(0).to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int64()), pa.array([list(np.abs(m).sum(0))], pa.list_(pa.float64())),
                                              pa.array([list((m * own > 0).sum(0).astype(float))], pa.list_(pa.float64()))], ["n", "size", "right"])

    seen = map_arrow(sample, judged, "n long, size array<double>, right array<double>")
    r = seen.agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[b]).alias(f"{c}{b}") for c in ("size", "right") for b in range(bits)]).first()
    scale = np.maximum(np.array([r[f"size{b}"] for b in range(bits)]) / r["n"], 1e-9)
    right = np.clip(np.array([r[f"right{b}"] for b in range(bits)]) / r["n"], 0.5, 1 - 1e-4)
    trust = np.maximum(np.log(right / (1 - right)), 1e-3)
    return LanguageModel(languages, code, weights, scale, trust / trust.sum())


PREDICTED = "lang_pred string, score double, ambiguous boolean"


def predict(rows: DataFrame, model: LanguageModel, text: str = "text", unclear: float = 0.2) -> DataFrame:
    """`rows` and the columns lang_pred, score (belief in it, 0 to 1) and ambiguous (the two best lie within `unclear`).

    A null text or one without a letter is `und` with score 0 and ambiguous; so is every text if no language was learned. Equal
    beliefs go to the language that sorts first. Existing columns of these names are replaced; rows repeat as they do in the input.
    """
    rows = rows.drop("lang_pred", "score", "ambiguous")
    at = rows.columns.index(text)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [*rows.columns, "lang_pred", "score", "ambiguous"]

    def run(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(at)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
            best, score, close = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if m.languages and letters.any():
                belief = m.decode(m.margins(_lower(column.filter(pa.array(letters)))))
                order = np.sort(belief, 1)
                best[letters], score[letters] = belief.argmax(1), order[:, -1]
                close[letters] = order[:, -1] - (order[:, -2] if belief.shape[1] > 1 else 0) < unclear
            found = [m.languages[i] if i >= 0 else "und" for i in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_arrow(rows, run, f"{kinds}, {PREDICTED}")


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id's text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` with predictions of a model that learned from its own rows outside the held-out quarter."""
    model = train(docs.where(~held_out(key) & F.col(key).isNotNull()))
    return predict(docs, model)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every row."""
    learn = docs.select("doc_id", "text", "lang")
    model = train(learn.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
