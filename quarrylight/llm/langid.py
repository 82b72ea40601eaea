"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic net,
with its probabilities calibrated by a temperature.

Features: character 1- to ``ORDERS``-grams of the whole text, lower case, runs
of anything but letters as one blank, hashed to ``BUCKETS`` places. Document
frequencies are counted over all labelled training documents. Weights are
fitted on a bounded sample: up to ``SAMPLE`` training documents, shared evenly
by the languages, chosen by hash of doc_id; a fifth of it is kept from the
fit and sets the temperature. Everything else covers all documents.

FTRL-proximal keeps for each coordinate a sum z of adjusted gradients and a sum
n of squares, and has the weight in closed form: 0 where |z| <= l1, else
-(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2).

Held out: documents whose crc32(doc_id) mod 4 is 2; neither counts nor weights
see them. Defined results: ``und`` with score 0 for a null text, a text without
a letter, or where nothing could be learned; a null doc_id has no remainder and
is held out (held_out true, not learned from); rows repeated are judged alike;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, ORDERS, SAMPLE, HELD = 1 << 15, 3, 2000, 2
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-3, 1e-4
PIECE = 1 << 19
NOT_LETTERS = r"[^\p{L}\p{M}]+"


def counts(text: str, orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each hashed n-gram of a text already folded."""
    out = np.zeros(buckets, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for a in range(0, len(code), PIECE):
        run = np.zeros(min(PIECE, len(code) - a), np.uint64)
        for n in range(1, orders + 1):
            b = code[a + n - 1 : a + n - 1 + len(run)]
            run = run[: len(b)] * np.uint64(0x100000001B3) + b + np.uint64(n)
            out += np.bincount((run * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64) % buckets, minlength=buckets)
    return out


@dataclass
class Model:
    """weights: buckets x languages, float32; scale: IDF of each bucket."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0

    def logits(self, found: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(found)
        return vector(found[at], self.scale[at]) @ self.weights[at] + self.bias

    def judge(self, text: str) -> tuple[str, float]:
        z = self.logits(counts(text)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def vector(found: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """TF-IDF of the places found, to length 1."""
    x = (1.0 + np.log(found)) * scale
    n = np.sqrt((x * x).sum())
    return x / n if n > 0 else x


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, buckets: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (places, values, class) rows."""
    z, n = np.zeros((buckets + 1, n_classes)), np.zeros((buckets + 1, n_classes))
    rng = np.random.default_rng(0)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value, label = rows[i]
            at, value = np.append(at, buckets), np.append(value, 1.0)
            w = weights(z[at], n[at])
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = value[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, lang, held_out, and the text in lower case with single blanks for
    what is not a letter (null where there is no letter)."""
    text = F.col("text").cast("string")
    fold = F.concat(F.lit(" "), F.lower(F.regexp_replace(text, NOT_LETTERS, " ")), F.lit(" "))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"), F.when(text.rlike(r"\p{L}"), fold).alias("fold"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("fold"):
            total += counts(text.as_py()) > 0
            n += 1
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["place", "df"])


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``folded`` rows that are labelled and not held out."""
    known = rows.filter("NOT held_out AND lang IS NOT NULL AND fold IS NOT NULL")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = max(1, sample // len(languages))
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30))
    bound = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, 1.2 * share / sizes[k]) * (1 << 30))))]), F.col("lang"))
    picked = known.withColumn("place", place).filter(F.col("place") < bound).select("lang", "place", "doc_id", "fold")
    # features first: what meets in one place is counts, not texts
    rows_ = picked.mapInArrow(_sampled, "lang string, place long, doc_id long, at binary, found binary").orderBy("place", "doc_id").limit(2 * sample).collect()
    df = known.select("fold").mapInArrow(_frequencies, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    seen = {r.place: r.df for r in df}
    n = seen.pop(-1)
    scale = np.full(BUCKETS, np.log(1.0 + n))
    for k, v in seen.items():
        scale[k] = np.log((1.0 + n) / (1.0 + v)) + 1.0
    fit_rows, check_rows, taken = [], [], dict.fromkeys(languages, 0)
    for r in sorted(rows_, key=lambda r: (r.place, r.doc_id)):
        if taken[r.lang] >= share:
            continue
        at, found = np.frombuffer(r.at, np.int32), np.frombuffer(r.found, np.int32)
        (check_rows if taken[r.lang] % 5 == 4 else fit_rows).append((at, vector(found, scale[at]), languages.index(r.lang)))
        taken[r.lang] += 1
    weights, bias = train_ftrl(fit_rows, len(languages), BUCKETS)
    model = Model(languages, weights.astype(np.float32), bias, scale)
    if check_rows:
        logits = np.array([v @ weights[at] + bias for at, v, _ in check_rows])
        model.temperature = max(0.05, fit_temperature(logits, np.array([y for _, _, y in check_rows])))
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t.as_py()) for t in batch.column("fold")]
        at = [np.flatnonzero(c).astype(np.int32) for c in found]
        yield pa.record_batch(
            [*(batch.column(c) for c in ("lang", "place", "doc_id")), pa.array([a.tobytes() for a in at]), pa.array([c[a].astype(np.int32).tobytes() for c, a in zip(found, at)])],
            ["lang", "place", "doc_id", "at", "found"],
        )


def _judged(model: Model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [("und", 0.0) if t is None else model.judge(t) for t in (x.as_py() for x in batch.column("fold"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return scan


def predict_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = folded(docs)
    model = fit(rows, sample)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.select("doc_id", "held_out", "fold").mapInArrow(_judged(model), "doc_id long, held_out boolean, lang_pred string, score double")


def remainder(doc_id: int) -> int:
    """crc32 of the decimal text of doc_id, modulo 4."""
    return zlib.crc32(str(doc_id).encode()) % 4
