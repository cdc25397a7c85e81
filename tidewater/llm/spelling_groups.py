"""Spelling variants by PartEnum signatures.

The letters of a word, as a multiset, are a binary vector: one dimension for each (letter, n-th occurrence).  One inserted or
deleted letter changes one dimension, one replaced letter two, so near words are at Hamming distance two at most.  The
dimensions are dealt into PARTS parts; two vectors that differ in at most two dimensions agree on some PARTS - 2
parts entirely.  Each word therefore enumerates one exact signature for every choice of PARTS - 2 parts, the
signatures meet in an equi-join, and each pair is verified by its edit distance.  No pair of near words is missed.

Anagrams and words of the same syllables have near multisets too.  One edit leaves a word's first letters or its last
ones alone (of LETTERS letters, the first half or the others), so a signature is joined once together with the
beginning and once with the end; that misses no pair either.  The join's sides are read from a written table, which
lets adaptive execution split the partition of a frequent signature.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.prefix_trie import CRC32_SQL, crc32_sql
from tidewater.llm.shared import Scratch, list_array, mix, signed, text_or_empty

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of the dimensions, differing dimensions of near words, and the choices of parts that stay.
PARTS, DISTANCE = 4, 2
CHOICES = list(combinations(range(PARTS), PARTS - DISTANCE))
LETTERS, OCCURRENCES, LEAST_RATIO = 7, 2, 10
DIVISOR = 31


def damaged(run, doc_id):
    """The run without one code point if DIVISOR divides crc32('<doc_id>:<run>'), else the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DIVISOR == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """(word, n): distinct words of at least ``letters`` code points and ``least`` occurrences in all documents.

    Words are maximal runs of Latin letters (a shorter run can give no word, so the pattern passes it over), A-Z
    lower-cased, after ``damaged``.  Null texts have none; a null id counts as an empty one.  Counts are
    partially aggregated before their shuffle.
    """
    run = f"({RUN[:-1]}{{{letters},}})"
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(run), 1)).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = low.select(damaged(F.col("run"), F.col("id")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def part_sums(words: list[str]) -> np.ndarray:
    """(words, PARTS): an order-free 64-bit hash of the dimensions that fall into each part."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    nth = np.arange(len(row)) - start
    dimension = mix(flat.astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64))
    part = (dimension >> np.uint64(40)) % np.uint64(PARTS)
    out = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(out, (row, part.astype(np.int64)), mix(dimension ^ np.uint64(0x5851F42D4C957F2D)))
    return out


def affixes(words: list[str], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the first letters // 2 code points and of the last letters - letters // 2."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    head, tail = np.zeros(len(words), np.uint64), np.full(len(words), 1, np.uint64)
    for i in range(letters // 2):
        head = mix(head * np.uint64(0x9E3779B97F4A7C15) + flat[end - size + i] + np.uint64(1))
    for i in range(letters - letters // 2):
        tail = mix(tail * np.uint64(0x9E3779B97F4A7C15) + flat[end - 1 - i] + np.uint64(1))
    return head, tail


def signatures(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, sig): two rows per word and choice of parts, with the word's beginning and with its end; odd for ends."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                some = batch.slice(at, 1 << 14)
                text = some.column(0).to_pylist()
                sums, sides = part_sums(text), affixes(text, letters)
                sigs = np.empty((len(text), 2 * len(CHOICES)), np.uint64)
                for c, choice in enumerate(CHOICES):
                    h = np.full(len(text), c + 1, np.uint64)
                    for p in choice:
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + sums[:, p])
                    for side, affix in enumerate(sides):
                        sigs[:, 2 * c + side] = mix(h ^ affix) & ~np.uint64(1) | np.uint64(side)
                counts = np.full(len(text), sigs.shape[1])
                yield pa.RecordBatch.from_arrays([some.column(0), list_array(signed(sigs.ravel()), counts, pa.int64())], names=["word", "sigs"])

    return words.select("word").mapInArrow(run, "word string, sigs array<long>").select("word", F.explode("sigs").alias("sig"))


def near_pairs(words: DataFrame, scratch: Scratch, letters: int = LETTERS) -> DataFrame:
    """(a, b), each pair of words one edit apart once, a < b; words of at least ``letters`` code points.

    Candidates are verified by their edit distance in code points while they are joined, so only near pairs leave the join.
    """
    sigs = scratch.write(signatures(words, letters), "signatures")
    a, b = sigs.select("sig", F.col("word").alias("a")), sigs.select("sig", F.col("word").alias("b"))
    twice = (F.col("sig").bitwiseAND(1) == 1) & (F.substring("a", 1, letters // 2) == F.substring("b", 1, letters // 2))
    pairs = a.join(b, "sig").where("a < b").where(F.abs(F.length("a") - F.length("b")) <= 1).where(~twice).where(F.levenshtein("a", "b", 1) == 1)
    return pairs.select("a", "b").distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = LEAST_RATIO) -> DataFrame:
    """One row per word: (word, n, n_near, form, form_n, root).

    ``n_near`` counts the words one edit (a code point inserted, deleted or replaced) away; ``form`` is the most frequent
    of them (ties: the first in code-point order) if it is at least ``ratio`` times as frequent, else null;
    ``root`` follows the forms to the last, and is the word itself without a form.  See ``word_table`` for nulls;
    repeated documents count again, other columns play no part, and an empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(word_table(docs, id_col, text_col), "words")
    pairs = scratch.write(near_pairs(words, scratch), "pairs")
    each = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    each = each.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = each.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("top"))
    rows = words.join(best, "word", "left")
    formed = -F.col("top.m") >= F.col("n") * ratio
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(formed, F.col("top.b")).alias("form"), F.when(formed, -F.col("top.m")).cast("long").alias("form_n"))
    rows = scratch.write(rows, "forms")
    # pointer doubling: a form is ratio times as frequent as its word, so chains are short
    links = scratch.write(rows.where("form is not null").select("word", F.col("form").alias("to")), "links")
    while True:
        onward = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        stepped = scratch.write(links.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "links")
        done = stepped.where("moved").isEmpty()
        scratch.drop(links)
        links = stepped
        if done:
            break
    return rows.join(links.select("word", "to"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


def op13_spelling_groups(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = rf"""
WITH RECURSIVE {CRC32_SQL.strip()},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
tokens AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LETTERS} GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc32_sql("(doc_id || ':' || run)")} AS h FROM tokens, crc_table),
results AS (SELECT CASE WHEN h % {DIVISOR} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT DISTINCT cut.word AS a, w.word AS b FROM cut JOIN words w ON w.word = cut.rest
         UNION SELECT w.word, cut.word FROM cut JOIN words w ON w.word = cut.rest
         UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(m := -n, b := b)) AS top FROM near JOIN words ON words.word = near.b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= {LEAST_RATIO} * w.n THEN top.b END AS form,
                 CASE WHEN -top.m >= {LEAST_RATIO} * w.n THEN -top.m END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS last FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.last WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, last AS root FROM walk JOIN forms f ON f.word = last WHERE f.form IS NULL)
SELECT f.word, f.n, CAST(n_near AS BIGINT) AS n_near, form, CAST(form_n AS BIGINT) AS form_n, root FROM forms f JOIN roots USING (word)
"""
