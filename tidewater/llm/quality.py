"""Quality rules: base counts, then a linear-chain CRF over the lines of a text.

Each line with a word is marked content or boilerplate by Viterbi decoding over line features
(case, symbols, repetition, shape) and learned transitions; the share of words in
content lines decides whether the document stays.  The CRF is trained on a bounded sample of
labelled documents (MAX_TRAIN of each label): a document's lines carry its quality
label.  Counting, features and decoding run in tasks on whole texts, many
documents per numpy step.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import mix, prefix_hash, span_hash, string_blocks, text_or_empty, word_spans

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
#: Labelled documents of each label that the CRF is fitted on, the smallest hashes of doc_id first.
MAX_TRAIN = 1000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;"]] = True


def _sum(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[ends] - c[starts]


def _repeats(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each (row, value): how often it occurs; and whether an earlier one is equal."""
    key = mix(value ^ mix(row.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(s)))
    count, earlier = np.empty(len(s), np.int64), np.empty(len(s), bool)
    count[order], earlier[order] = np.repeat(n, n), ~first
    return count, earlier


def measure(offs: np.ndarray, data: np.ndarray):
    """Base counts of each row, and of each line with a word: its row, words and features."""
    rows = len(offs) - 1
    starts, ends, row = word_spans(offs, data)
    n_words = np.bincount(row, minlength=rows)
    h = prefix_hash(data)
    word = span_hash(h, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    lead = (data & 0xC0) != 0x80
    word_chars = np.bincount(row, _sum(lead, starts, ends), minlength=rows).astype(np.int64)
    n_symbols = _sum(_SYMBOL[data], offs[:-1], offs[1:])
    # words in three-word windows that occur twice or more
    covered = np.zeros(len(starts) + 2, bool)
    if len(starts) > 2:
        whole = row[2:] == row[:-2]
        k = np.flatnonzero(whole)
        a = word[k] * np.uint64(0x9E3779B97F4A7C15) + word[k + 1]
        count, _ = _repeats(row[k], mix(a) * np.uint64(0xC2B2AE3D27D4EB4F) + word[k + 2])
        k = k[count > 1]
        covered[k] = covered[k + 1] = covered[k + 2] = True
    covered = covered[:len(starts)]
    n_repeat = np.bincount(row[covered], minlength=rows)
    # lines: between \n and the rows' borders; those with a word
    cut = np.unique(np.concatenate([offs, np.flatnonzero(data == 10) + 1]))
    cut = cut[cut <= len(data)]
    ls, le = cut[:-1], cut[1:]
    if len(ls):
        le = le - (data[np.maximum(le - 1, 0)] == 10)
    first = np.searchsorted(starts, ls)
    last = np.searchsorted(starts, le)
    some = last > first
    ls, le, first, last = ls[some], le[some], first[some], last[some]
    lrow = np.searchsorted(offs, ls, "right") - 1
    n, earlier = _repeats(lrow, span_hash(h, ls, le)) if len(ls) else (np.zeros(0, int), np.zeros(0, bool))
    n_dup = np.bincount(lrow[earlier], minlength=rows)
    words = last - first
    size = np.maximum(le - ls, 1)
    same = np.zeros(len(starts), bool)
    if len(starts) > 1:
        same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    share = lambda flags: _sum(flags, first, last) / np.maximum(words, 1)
    symbol = _sum(_SYMBOL[data], ls, le) / np.maximum(words, 1)
    shout = _sum(data == 33, ls, le) / np.maximum(words, 1)
    upper = _sum(_UPPER[data], ls, le) / size
    digit = _sum(_DIGIT[data], ls, le) / size
    again, twice = share(covered), share(same)
    final = _END[data[np.maximum(ends[np.maximum(last - 1, 0)] - 1, 0)]] if len(ls) else np.zeros(0, bool)
    length = _sum(lead, ls, le) / np.maximum(words, 1)
    features = np.stack([np.ones(len(ls), bool), upper > 0.3, symbol > 0.1, symbol > 0.4, shout > 0.3, digit > 0.3, n > 1,
                         again > 0.3, again > 0.7, twice > 0.2, words < 4, ~final, length > 14, length < 3], 1).astype(np.int8) if len(ls) else np.zeros((0, N_FEATURES), np.int8)
    base = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    return base, lrow, words, features


N_FEATURES = 14


# ---------------------------------------------------------------- the chain

def _ladder(lengths: np.ndarray):
    """Order by falling length, so the sequences that reach step t are the first rows."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    return order, starts, lengths[order]


class Crf:
    """Two labels (0 boilerplate, 1 content): weights (features x 2), transitions and start scores."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, start: np.ndarray):
        self.weights, self.steps, self.start = weights, steps, start

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of each line; lines of a sequence are neighbours, sequences have ``lengths`` (over 0).
        Ties go to content."""
        score = features @ self.weights
        order, starts, size = _ladder(lengths)
        back = np.zeros((len(features), 2), np.int8)
        best = np.empty((len(size), 2))
        last = np.empty((len(size), 2))
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "left"))  # sequences longer than t
            at = starts[:m] + t
            if t == 0:
                best[:m] = self.start + score[at]
            else:
                via = best[:m, :, None] + self.steps[None]
                back[at] = np.where(via[:, 1] >= via[:, 0], 1, 0)
                best[:m] = via.max(1) + score[at]
            last[:m] = best[:m]
        labels = np.zeros(len(features), np.int8)
        state = np.where(last[:, 1] >= last[:, 0], 1, 0)
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            m = int(np.searchsorted(-size, -t, "left"))
            at = starts[:m] + t
            labels[at] = state[:m]
            state[:m] = back[at, state[:m]]
        return labels

    @staticmethod
    def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.3, penalty: float = 0.02):
        """Maximum likelihood by forward-backward and Adam, with an L2 penalty."""
        x = features.astype(float)
        order, starts, size = _ladder(lengths)
        theta = np.zeros(x.shape[1] * 2 + 4 + 2)
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        onehot = np.eye(2)[labels]
        firsts = starts
        follow = np.ones(len(x), bool)
        follow[firsts] = False
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (labels[np.flatnonzero(follow) - 1], labels[follow]), 1)
        total = len(size)
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]
        for k in range(1, rounds + 1):
            w, a, s = theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
            score = x @ w
            alpha, beta = np.empty((len(x), 2)), np.zeros((len(x), 2))
            for t, m in enumerate(live):
                at = starts[:m] + t
                if t == 0:
                    alpha[at] = s + score[at]
                else:
                    alpha[at] = np.logaddexp(alpha[at - 1, 0, None] + a[0], alpha[at - 1, 1, None] + a[1]) + score[at]
            edge = np.zeros((2, 2))
            z = np.repeat(0.0, len(x))
            ends = starts + size - 1
            zs = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
            for t in range(len(live) - 1, 0, -1):
                m = live[t]
                at = starts[:m] + t
                ahead = score[at] + beta[at]
                beta[at - 1] = np.logaddexp(a[:, 0] + ahead[:, 0, None], a[:, 1] + ahead[:, 1, None])
                edge += np.exp(alpha[at - 1][:, :, None] + a + ahead[:, None, :] - zs[:m, None, None]).sum(0)
            z[np.concatenate([np.arange(b, b + n) for b, n in zip(starts, size)])] = np.repeat(zs, size)
            p = np.exp(alpha + beta - z[:, None])
            g = np.concatenate([(x.T @ (p - onehot)).ravel(), (edge - pairs).ravel(), (p[firsts] - onehot[firsts]).sum(0)]) / total + penalty * theta / 10
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta = theta - rate * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.99 ** k)) + 1e-9)
        return Crf(theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Crf | None:
    """The CRF of a bounded sample: ``max_train`` documents of either label, by hash of the id.

    Only the sample's line features reach the driver.  None if one of the labels has no
    document with a line (then every line counts as content).
    """
    lab = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    picked = [lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_train) for y in (0, 1)]
    sample = picked[0].union(picked[1])
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "id")

    def run(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            for row, offs, data in string_blocks(batch.column("text")):
                _, lrow, _, features = measure(offs, data)
                n = np.bincount(lrow, minlength=len(offs) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(y[row:row + len(n)], pa.int32()), pa.array(n, pa.int64()),
                                                  pa.array([f.tobytes() for f in np.split(features, np.cumsum(n)[:-1])], pa.binary())], names=["y", "n", "features"])

    got = rows.select("y", "text").mapInArrow(run, "y int, n long, features binary").where("n > 0").toArrow()
    y, n = got["y"].to_numpy(), got["n"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    raw = got["features"].to_pylist()
    order = sorted(range(len(raw)), key=lambda i: (y[i], raw[i]))  # the fit doesn't depend on the order of tasks
    x = np.frombuffer(b"".join(raw[i] for i in order), np.int8).reshape(-1, N_FEATURES)
    return Crf.fit(x, n[order], np.repeat(y[order], n[order]))


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"


def judge(docs: DataFrame, model: Crf | None, keep: list[str] | None = None, text_col: str = "text",
          min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) as struct ``row``, and beside it the columns of OUT.

    Null counts as empty: no words, base_failed.  A text without words has content_share 0.
    Every row is judged by itself: repeated rows get equal results; an empty table stays empty.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string
    rows = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), text_or_empty(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for at, offs, data in string_blocks(batch.column("text")):
                base, lrow, words, features = measure(offs, data)
                rows_n = len(offs) - 1
                lines = np.bincount(lrow, minlength=rows_n)
                good = np.ones(len(lrow), bool) if model is None else model.viterbi(features, lines[lines > 0]) == 1
                share = np.bincount(lrow[good], words[good], minlength=rows_n) / np.maximum(base[:, 0], 1)
                failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
                cols = [batch.column("row").slice(at, rows_n), *[pa.array(base[:, i]) for i in range(5)], pa.array(failed), pa.array(lines.astype(np.int64)),
                        pa.array(np.bincount(lrow[good], minlength=rows_n).astype(np.int64)), pa.array(share), pa.array(~failed & (share >= min_share))]
                yield pa.RecordBatch.from_arrays(cols, names=["row", *_parse_names(OUT)])

    schema = StructType([StructField("row", rows.schema["row"].dataType), *_parse_datatype_string(OUT).fields])
    return rows.mapInArrow(run, schema)


def _parse_names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(",")]


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = judge(docs, model, ["doc_id"])
    return out.select("row.doc_id", *_parse_names(OUT))


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that stay, with all their columns."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model).where("kept").select("row.*")
