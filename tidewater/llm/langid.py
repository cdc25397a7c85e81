"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become case-folded letters and spaces; their 1- to 3-grams are hashed into BUCKETS
features.  Document frequencies are counted over every training document (one
bounded vector per task, summed by Spark).  The classifier is fitted on a bounded sample
(MAX_TRAIN documents a language) by follow-the-regularised-leader with an elastic net, then a
temperature is fitted on a part of the sample that the training did not see.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import mix, string_blocks, text_or_empty

BUCKETS = 1 << 15
#: Documents of each language in the fitting sample, the smallest hashes of doc_id first; one in CALIBRATE of them sets the temperature.
MAX_TRAIN = 500
CALIBRATE = 5
FOLDS, HELD_OUT = 4, 2
_tables: list = []


def _letters():
    """Lower-case of each code point where that is one letter, a space for all that are no letters."""
    if not _tables:
        low = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                t = s.lower()
                low[c] = ord(t) if len(t) == 1 else c
        _tables.append(low)
    return _tables[0]


def grams(offs: np.ndarray, data: np.ndarray):
    """(offsets, bucket of each position's 1-, 2- and 3-gram): rows x positions; -1 where a gram has no letter
    or passes its text's end."""
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])[offs]
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    c = _letters()[code].astype(np.uint64)
    n = len(c)
    left = np.repeat(chars[1:], np.diff(chars)) - np.arange(n)  # characters to the text's end
    letter = c != 32
    out = np.full((3, n), -1, np.int32)
    key, some = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(3):
        key = key * np.uint64(0x110003) + np.concatenate([c[k:], np.full(min(k, n), 32, np.uint64)]) + np.uint64(1)
        some = some | np.concatenate([letter[k:], np.zeros(min(k, n), bool)])
        ok = some & (left > k)
        out[k, ok] = (mix(key[ok] + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32)
    return chars, out


def counts_of(offs: np.ndarray, data: np.ndarray):
    """For each row: (its buckets, their counts)."""
    chars, g = grams(offs, data)
    for a, b in zip(chars[:-1].tolist(), chars[1:].tolist()):
        mine = g[:, a:b].ravel()
        mine = mine[mine >= 0]
        if len(mine) > 4000:
            n = np.bincount(mine, minlength=BUCKETS)
            k = np.flatnonzero(n)
            yield k, n[k]
        else:
            yield np.unique(mine, return_counts=True)


def weighted(buckets, counts, idf):
    x = np.log1p(counts) * idf[buckets]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


class Model:
    def __init__(self, langs, idf, weights, bias, temperature):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def predict(self, buckets, counts):
        z = (weighted(buckets, counts, self.idf) @ self.weights[buckets] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def ftrl(rows, y, classes: int, idf, passes: int = 3, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002):
    """Multinomial FTRL-proximal; the elastic net keeps weights of useless n-grams at exactly 0."""
    z, n = np.zeros((len(idf) + 1, classes)), np.zeros((len(idf) + 1, classes))

    def weights(k):
        zk = z[k]
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2))

    for _ in range(passes):
        for (b, c), t in zip(rows, y):
            k = np.append(b, len(idf))
            x = np.append(weighted(b, c, idf), 1.0)
            w = weights(k)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[t] -= 1.0
            g = x[:, None] * p[None]
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - sigma * w
            n[k] += g * g
    w = weights(np.arange(len(idf) + 1))
    return w[:-1], w[-1]


def train(docs: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from ``docs`` (all rows are training rows; those without lang are ignored); None without any."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text")).where("lang is not null")

    def frequencies(batches):
        df, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, offs, data in string_blocks(batch.column("text")):
                for b, _ in counts_of(offs, data):
                    df[b] += 1
                    total += 1
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, BUCKETS), pa.int32()), pa.array(np.append(df[k], total), pa.int64())], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS + 1)
    df[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    total = df[BUCKETS]
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df[:BUCKETS])) + 0.05
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    picked = rows.select("id", "lang").distinct().withColumn("place", place).where(F.col("place") <= max_train)

    def features(batches):
        for batch in batches:
            lang = batch.column("lang")
            for row, offs, data in string_blocks(batch.column("text")):
                got = list(counts_of(offs, data))
                yield pa.RecordBatch.from_arrays([
                    lang.slice(row, len(got)), pa.array([b.astype(np.int32).tobytes() for b, _ in got], pa.binary()),
                    pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())], names=["lang", "buckets", "counts"])

    sample = rows.join(picked.select("id", "lang"), ["id", "lang"]).select("lang", "text").mapInArrow(features, "lang string, buckets binary, counts binary").toArrow()
    got = sorted((a, b, c) for a, b, c in zip(sample["lang"].to_pylist(), sample["buckets"].to_pylist(), sample["counts"].to_pylist()) if b)
    langs = sorted({a for a, _, _ in got})
    if not langs:
        return None
    order = np.random.RandomState(11).permutation(len(got))
    x = [(np.frombuffer(got[i][1], np.int32), np.frombuffer(got[i][2], np.int32)) for i in order]
    y = [langs.index(got[i][0]) for i in order]
    cut = len(x) // CALIBRATE if len(x) >= 5 * CALIBRATE else 0
    w, bias = ftrl(x[cut:], y[cut:], len(langs), idf)
    model = Model(langs, idf, w.astype(np.float32), bias, 1.0)
    if cut:
        logits = np.array([weighted(b, c, idf) @ w[b] + bias for b, c in x[:cut]])
        truth = np.array(y[:cut])

        def loss(t):
            s = logits / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(cut), truth]).mean())
        model.temperature = min((loss(t), t) for t in np.geomspace(0.05, 5.0, 60))[1]
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score.

    A null text, one without a letter, and any text without a model: 'und' with score 0.
    Equal scores: the language first in text order.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), text_or_empty(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for at, offs, data in string_blocks(batch.column("text")):
                got = [model.predict(b, c) if len(b) and model else ("und", 0.0) for b, c in counts_of(offs, data)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(got)), pa.array([g[0] for g in got], pa.string()),
                                                  pa.array([g[1] for g in got], pa.float64())], names=["row", "lang_pred", "score"])

    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = train(docs.where("not held_out"))
    return predict(docs, model, ["doc_id", "held_out"])
