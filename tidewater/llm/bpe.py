"""Byte-level BPE encoding and decoding.

A vocabulary file gives byte symbols and ranked merges.  Documents are cut into words by the
vocabulary's pattern; the distinct words of a batch become one flat symbol array, and each
round looks every neighbouring pair up by binary search in the sorted pair keys, takes
each word's lowest rank and merges all its occurrences at once.  Words that have no more
merges leave the array.  Work is per row, so Spark deals it out without any shuffle.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import list_array, string_blocks, text_or_empty

#: The published pattern of this kind of vocabulary; white space is Unicode's White_Space.
_WS = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+")
#: Distinct words that a worker remembers before it starts anew.
MEMO_WORDS = 100_000
#: Bytes of text, or ids, that one numpy step handles (a longer single row is handled alone).
BLOCK_IDS = 1 << 18
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of this kind:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Arrays of a vocabulary; small (bounded by the file) and sent with the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), pairs[order, 2]
        self.by_rank = pairs[:, 2]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.token_at = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.token_at[1:])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode_words(self, words: list[bytes]):
        """(ids of all words in one array, number of ids of each word)."""
        lens = np.array([len(w) for w in words], np.int64)
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done_word, done_ids = [], []
        while len(flat):
            same = word[:-1] == word[1:]
            key = flat[:-1] << 32 | flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            rank = np.full(len(flat), NONE)
            if len(self.keys):
                hit = same & (self.keys[at] == key)
                rank[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(flat)))
            open_ = np.repeat(lowest != NONE, size)
            if not open_.all():
                done_word.append(word[~open_])
                done_ids.append(flat[~open_])
                flat, word, rank = flat[open_], word[open_], rank[open_]
                size = size[lowest != NONE]
                lowest = lowest[lowest != NONE]
                if not len(flat):
                    break
            take = rank == np.repeat(lowest, size)
            # overlapping occurrences (one symbol repeated): from the left, every second one
            spots = np.flatnonzero(take)
            fresh = np.concatenate([[True], np.diff(spots) != 1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))
            spots = spots[(np.arange(len(spots)) - start) % 2 == 0]
            flat = flat.copy()
            flat[spots] = self.by_rank[rank[spots]]
            keep = np.ones(len(flat), bool)
            keep[spots + 1] = False
            flat, word = flat[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def decode_rows(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each row's ids; ids outside the vocabulary have none."""
        size = len(self.token_at) - 1
        known = np.clip(ids, 0, size - 1)
        n = np.where((ids >= 0) & (ids < size), self.token_at[known + 1] - self.token_at[known], 0)
        flat = gather(self.token_bytes, self.token_at[known], n).tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encoder(self):
        """A function from a list of texts to (flat ids, number of ids of each text)."""
        words_of = regex.compile(PATTERN).findall
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        memo: dict[str, int] = {}
        ids, starts, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def encode(texts: list[str]):
            nonlocal ids, starts, counts
            if len(memo) > MEMO_WORDS:
                memo.clear()
                ids, starts, counts = (np.zeros(0, np.int64),) * 3
            new: list[str] = []
            where: list[int] = []
            sizes = np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                if cut and any(s in text for s in self.special):
                    parts = [p for p in cut.split(text) if p]
                    words = [w for p in parts for w in (["\0" + p] if p in self.special else words_of(p))]
                else:
                    words = words_of(text)
                for w in words:
                    k = memo.get(w)
                    if k is None:
                        k = memo[w] = len(memo)
                        new.append(w)
                    where.append(k)
                sizes[i] = len(words)
            if new:
                plain = [w.encode() if not (w[0] == "\0" and w[1:] in self.special) else b"" for w in new]
                got, n = self.encode_words(plain)
                if any(not p for p in plain):
                    n = np.where([not p for p in plain], 1, n)
                    full = np.zeros(n.sum(), np.int64)
                    at = np.cumsum(n) - n
                    mark = np.repeat([not p for p in plain], n)
                    full[~mark] = got
                    for j, w in enumerate(new):
                        if not plain[j]:
                            full[at[j]] = self.special[w[1:]]
                    got = full
                starts = np.concatenate([starts, len(ids) + np.cumsum(n) - n])
                counts = np.concatenate([counts, n])
                ids = np.concatenate([ids, got])
            k = np.array(where, np.int64)
            flat = gather(ids, starts[k], counts[k])
            ends = np.cumsum(sizes)
            total = np.concatenate([[0], np.cumsum(counts[k])])
            return flat, total[ends] - total[ends - sizes]
        return encode


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start : start + count] of each pair, one after the other."""
    total = int(counts.sum())
    step = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return values[step + np.arange(total)]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(texts: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Replace ``text_col`` by ``out_col``, the token ids of each whole text (array<int>).

    Null counts as empty; an empty text has an empty list.  A special token's own string in a text is
    that token.  Rows, their order and all other columns stay; an empty table stays empty.
    """
    rest = [c for c in texts.columns if c != text_col]
    rows = texts.select(*[texts[c] for c in rest], text_or_empty(text_col).alias("\1text"))

    def run(batches):
        encoder = vocabulary.encoder()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for row, offs, data in string_blocks(column):
                raw = data.tobytes()
                part = [raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                flat, counts = encoder(part)
                cols = [batch.column(i).slice(row, len(part)) for i in range(batch.num_columns - 1)]
                cols.append(list_array(flat.astype(np.int32), counts, pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], out_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
    schema = StructType([*[texts.schema[c] for c in rest], StructField(out_col, ArrayType(IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Add ``out_col``: the text of each row's ids; invalid UTF-8 becomes U+FFFD.

    Null and empty lists give an empty text; ids outside the vocabulary are left out.
    """
    rest = tokens.columns
    rows = tokens.select(*[tokens[c] for c in rest], F.coalesce(tokens[ids_col], F.array().cast("array<int>")).alias("\1ids"))

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            row = 0
            while row < batch.num_rows:
                # rows whose ids fit into one block; a longer row alone
                stop = max(int(np.searchsorted(ends, ends[row] + BLOCK_IDS, "right")) - 1, row + 1)
                ids = lists.values[ends[row]:ends[stop]].to_numpy(zero_copy_only=False).astype(np.int64)
                texts = [t.decode("utf-8", "replace") for t in vocabulary.decode_rows(ids, np.diff(ends[row:stop + 1]))]
                cols = [batch.column(i).slice(row, stop - row) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], out_col])
                row = stop

    from pyspark.sql.types import StringType, StructField, StructType
    return rows.mapInArrow(run, StructType([*tokens.schema.fields, StructField(out_col, StringType())]))


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, see ``encode`` and ``decode``.

    One step encodes a block of texts, decodes the ids and hashes both, so a task has one Python worker and only the
    digests leave it.  Null counts as empty.
    """
    def run(batches):
        encoder = vocabulary.encoder()
        for batch in batches:
            for row, offs, data in string_blocks(batch.column(1), BLOCK_IDS):
                raw = data.tobytes()
                flat, counts = encoder([raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
                ends = np.cumsum(counts).tolist()
                ids = [hashlib.sha256(",".join(map(str, flat[b - n:b].tolist())).encode()).hexdigest() for b, n in zip(ends, counts.tolist())]
                texts = [hashlib.sha256(t.decode("utf-8", "replace").encode()).hexdigest() for t in vocabulary.decode_rows(flat, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(ids)), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers
    vocabulary = Vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token counts and digests of ids and decoded text of every row."""
    import public_tokenizers
    return digests(docs, Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
