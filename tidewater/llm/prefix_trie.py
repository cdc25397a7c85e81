"""Prefix trie of conversations: sparse-table range minima over sorted LCPs.

A conversation is the sequence of its turns' 128-bit digests, 16 bytes a turn in one key.  Spark range-partitions the
keys (the id breaks ties, so a conversation that a third of all rows repeat still spreads over partitions) and sorts
them.  Sorted rows are handled in blocks: the longest common prefix of each pair of neighbours, a sparse table of
range minima over these, and for each candidate prefix a binary search to the left and one to the right, independent of
all others, for how far the minimum stays at the prefix's depth.  That is its interval of members; no stack is kept.

A prefix whose interval touches a block's border may go on in the next block.  Such prefixes are the beginnings of a
block's first or last row only; their fragments are merged by a pre-aggregated group-by on the prefix's digest.  Sums
over a subtree are prefix sums over the nodes in order of (first member, depth): inside a block for the
others, over the merged border prefixes for these (a few per block).  Ids that end at a border prefix travel as
one text per block, and are hashed as a stream.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch

#: Bounds of a block: conversations, and turns (a longer conversation is a block alone).
BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 20
DIGEST = 16
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- sequences

def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, words) pairs.

    Order: null turn numbers first, then by number; turns with one number by the digest of (role, text).  Null role
    or text is empty.  Rows without a conv_id belong to no conversation and are left out.  A conversation's
    list holds 50 bytes a turn and must fit into a task, like a text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                 F.md5(F.concat(role, F.lit("\u0000"), text).cast("binary")).alias("d"), F.regexp_count(text, F.lit(WORD)).alias("w")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def rebuilt(lists: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Replace the first h turns of conversation c, h = crc32(decimal c) mod ``most``, by those of conversation
    c - c % ``group`` (as many as it has; none if it is absent).  The remainder has the sign of c, as in SQL."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = lists.select("conv_id", "turns", h.alias("h"), F.when(h > 0, F.col("conv_id") - F.col("conv_id") % group).alias("source"))
    heads = lists.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("source"), F.slice("turns", 1, most - 1).alias("head"))
    both = own.join(heads, "source", "left")
    none = F.array().cast(lists.schema["turns"].dataType)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    head = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.col("h"))).otherwise(none)
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def keyed(lists: DataFrame) -> DataFrame:
    """(conv_id, key, words): the digests one after the other, and the words of each turn."""
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), "")).alias("key"),
                        F.transform("turns", lambda t: t["w"].cast("int")).alias("words"))


# ---------------------------------------------------------------- one block

def sparse_table(a: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of 2**k neighbours."""
    out, k = [a], 1
    while 2 * k <= len(a):
        last = out[-1]
        out.append(np.minimum(last[:-k], last[k:]))
        k *= 2
    return out


def range_min(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum over [left, right], ends included."""
    k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), table[0].dtype)
    for level in np.unique(k):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(table[level][left[at]], table[level][right[at] - (1 << level) + 1])
    return out


def reach(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval around row ``at`` whose rows share ``depth`` turns; table over lcp[1:].

    Each candidate steps by falling powers of two as long as the range minimum allows it.
    """
    left, right = at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        level, size = table[k], 1 << k
        can = right + size < rows
        spot = np.flatnonzero(can)
        spot = spot[level[right[spot]] >= depth[spot]]
        right[spot] += size
        spot = np.flatnonzero(left >= size)
        spot = spot[level[left[spot] - size] >= depth[spot]]
        left[spot] -= size
    return left, right


def common_prefixes(digests: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lcp[i] of rows i-1 and i; -1 before the first and after the last row."""
    n = len(size)
    lcp = np.zeros(n + 1, np.int64)
    lcp[0] = lcp[n] = -1
    at, depth = np.arange(1, n), 0
    while len(at):
        at = at[np.minimum(size[at], size[at - 1]) > depth]
        at = at[(digests[first[at] + depth] == digests[first[at - 1] + depth]).all(1)]
        depth += 1
        lcp[at] = depth
    return lcp


def _arange(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def block_nodes(keys: list[bytes], words: np.ndarray, conv: np.ndarray, block: int):
    """Rows of NODE for one block of sorted conversations: complete nodes, and fragments of border prefixes."""
    n = len(keys)
    size = np.array([len(k) // DIGEST for k in keys], np.int64)
    first = np.cumsum(size) - size
    digests = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    lcp = common_prefixes(digests, first, size)
    table = sparse_table(lcp[1:n]) if n > 1 else []
    # candidates: every conversation's whole sequence, every neighbours' common prefix; equal intervals are one
    at = np.concatenate([np.arange(n), np.arange(1, n)])
    deep = np.concatenate([size, lcp[1:n]])
    left, right = reach(table, at, deep, n)
    _, one = np.unique(left << 32 | deep, return_index=True)
    left, right, deep = left[one], right[one], deep[one]
    low = np.maximum(lcp[left], lcp[right + 1]) + 1
    # each interval has one node per depth from low to deep; pre-order is (left, depth) already
    counts = deep - low + 1
    of = np.repeat(np.arange(len(left)), counts)
    end = np.cumsum(counts) - 1                      # the deepest node of each interval
    depth = _arange(low, counts)
    l, r = left[of], right[of]
    members = r - l + 1
    conv_min = range_min(sparse_table(conv), l, r)
    last_words = np.where(depth > 0, np.append(words, 0)[np.where(depth > 0, first[l] + depth - 1, 0)], 0)
    # parents: one turn less, in the same interval or the interval around it
    parent = np.arange(len(of)) - 1
    upper = np.flatnonzero(low > 0)
    if len(upper):
        up_left, _ = reach(table, left[upper], low[upper] - 1, n)
        key = left << 32 | deep
        parent[end[upper] - counts[upper] + 1] = end[np.searchsorted(key, up_left << 32 | (low[upper] - 1))]
    parent[depth == 0] = -1
    border = (l == 0) | (r == n - 1)
    has = parent >= 0
    children = np.bincount(parent[has], minlength=len(of))
    own_children = np.bincount(parent[has & ~border], minlength=len(of))
    leaf = (children == 0) & ~border
    saved = np.where(border, 0, (members - 1) * last_words)
    stop = np.searchsorted(l, r, "right")
    leaf_sum, saved_sum = (np.concatenate([[0], np.cumsum(x)]) for x in (leaf, saved))
    here = np.arange(len(of))
    leaves, saving = leaf_sum[stop] - leaf_sum[here], saved_sum[stop] - saved_sum[here]
    # conversations that end at a node are the first of its interval
    start = np.concatenate([[True], ~((lcp[1:n] == size[1:]) & (size[1:] == size[:-1]))])
    run = np.diff(np.append(np.flatnonzero(start), n))
    length = np.zeros(n, np.int64)
    length[start] = run
    ends = np.where(size[l] == depth, length[l], 0)
    ids = [",".join(map(str, conv[a:a + m].tolist())) if m else "" for a, m in zip(l.tolist(), ends.tolist())]

    def digests_of(row: int) -> list[str]:
        h = hashlib.md5()
        out = [h.hexdigest()]
        for d in range(size[row]):
            h.update(keys[row][d * DIGEST:(d + 1) * DIGEST])
            out.append(h.copy().hexdigest())
        return out

    names = {0: digests_of(0), n - 1: digests_of(n - 1)}
    name = lambda j: names[0 if l[j] == 0 else n - 1][depth[j]]
    parent_conv = np.where(has, conv_min[parent], 0)
    for j in here.tolist():
        p = int(parent[j])
        outer = border[p] if p >= 0 else False
        spot = (block << 20) + int(l[j]), (block << 20) + int(r[j])
        yield (bool(border[j]), name(j) if border[j] else None, int(depth[j]), int(conv_min[j]), name(p) if outer else None,
               int(parent_conv[j]) if p >= 0 and not outer else None, spot[0], spot[1], int(members[j]), int(last_words[j]),
               int(own_children[j] if border[j] else children[j]), int(leaves[j]), int(saving[j]),
               ids[j] if border[j] else None, None if border[j] else (hashlib.sha256(ids[j].encode()).hexdigest() if ids[j] else EMPTY_SHA))


NODE = [("border", pa.bool_()), ("name", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent", pa.string()),
        ("parent_conv_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()),
        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ids", pa.string()), ("ends_sha256", pa.string())]
NODE_SQL = ("border boolean, name string, depth long, conv_id long, parent string, parent_conv_id long, first long, last long, n_convs long, "
            "words long, n_children long, n_leaves long, saved_tokens long, ids string, ends_sha256 string")


def _rows(rows, most: int = 8192):
    """Record batches of at most ``most`` node rows, or 16 MB of ids."""
    held, volume = [], 0
    for row in rows:
        held.append(row)
        volume += len(row[13] or "")
        if len(held) >= most or volume > 1 << 24:
            yield _batch(held)
            held, volume = [], 0
    if held:
        yield _batch(held)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), NODE)], names=[n for n, _ in NODE])


def _blocks(batches):
    keys, words, conv, part = [], [], [], 0
    turns = 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        lists = batch.column(2)
        for i, key in enumerate(batch.column(1)):
            key = key.as_py()
            if keys and (len(keys) >= BLOCK_ROWS or turns + len(key) // DIGEST > BLOCK_TURNS):
                yield part, keys, np.concatenate(words), np.array(conv, np.int64)
                keys, words, conv, turns, part = [], [], [], 0, part + 1
            keys.append(key)
            words.append(lists[i].values.to_numpy(zero_copy_only=False).astype(np.int64))
            conv.append(ids[i])
            turns += len(key) // DIGEST
    if keys:
        yield part, keys, np.concatenate(words), np.array(conv, np.int64)


def _nodes_of_blocks(batches):
    task = TaskContext.get().partitionId()
    for part, keys, words, conv in _blocks(batches):
        yield from _rows(block_nodes(keys, words, conv, (task << 20) + part))


# ---------------------------------------------------------------- border prefixes

def _subtrees(batches):
    """n_leaves and saved_tokens of the border prefixes, all in one task: a few rows per block."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    col = {c: table.column(c).to_numpy() for c in ("depth", "first", "last", "n_convs", "words", "n_children", "n_leaves", "saved_tokens")}
    order = np.lexsort((col["depth"], col["first"]))
    col = {c: v[order] for c, v in col.items()}
    leaf = (col["n_children"] == 0).astype(np.int64)
    saved = (col["n_convs"] - 1) * col["words"]
    stop = np.searchsorted(col["first"], col["last"], "right")
    here = np.arange(len(order))
    for own, name in ((leaf, "n_leaves"), (saved, "saved_tokens")):
        sums = np.concatenate([[0], np.cumsum(own)])
        col[name] = col[name] + sums[stop] - sums[here]
    out = table.take(pa.array(order)).select(["name", "depth", "conv_id", "parent", "n_convs", "n_children"])
    yield from out.append_column("n_leaves", pa.array(col["n_leaves"])).append_column("saved_tokens", pa.array(col["saved_tokens"])).combine_chunks().to_batches()


def _streamed_sha(batches):
    """SHA-256 of each name's ids, which arrive in order, one text per block; only the running state is held."""
    name, h, depth = None, None, None
    done = []
    for batch in batches:
        for n, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (n, d) != (name, depth):
                if h is not None:
                    done.append((name, depth, h.hexdigest()))
                name, depth, h = n, d, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.as_buffer())
    if h is not None:
        done.append((name, depth, h.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["name", "depth", "sha"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie over (conv_id, key, words) rows of distinct conv_id, see ``keyed``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest
    member, the turns, the parent's smallest member (null for the root), members, children, childless nodes of the
    subtree (a childless node counts itself), (members - 1) * words of the last turn summed over the subtree, and the
    SHA-256 of the ids that end at the node, ascending and comma-joined.  A conversation without a turn ends at the
    root.  No conversation, no node, not even a root.  Turns are told apart by 128-bit digests.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = sequences.select("conv_id", "key", "words").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = scratch.write(ordered.mapInArrow(_nodes_of_blocks, NODE_SQL), "nodes")
    parted = found.where("border")
    merged = parted.groupBy("name", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("n_convs").alias("n_convs"), F.first("words").alias("words"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    merged = scratch.write(merged, "border")
    kids = merged.where("parent is not null").groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("more"))
    merged = merged.join(kids, ["name", "depth"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    whole = merged.repartition(1).mapInArrow(_subtrees, "name string, depth long, conv_id long, parent string, n_convs long, n_children long, n_leaves long, saved_tokens long")
    whole = scratch.write(whole, "merged")
    ends = parted.where("ids <> ''").select("name", "depth", "ids", "first").repartition(parts, "name", "depth").sortWithinPartitions("name", "depth", "first")
    ends = ends.select("name", "depth", "ids").mapInArrow(_streamed_sha, "name string, depth long, sha string")
    names = whole.select(F.col("name").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("outer"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = (whole.join(ends, ["name", "depth"], "left").join(names, ["parent", "depth"], "left")
                .withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA))).withColumn("parent_conv_id", F.col("outer")).select(*columns))
    inner = found.where("not border")
    hung = inner.where("parent is not null").join(names, ["parent", "depth"]).withColumn("parent_conv_id", F.col("outer")).select(*columns)
    return top.unionByName(hung).unionByName(inner.where("parent is null").select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see ``turn_lists``, ``rebuilt`` and ``prefix_trie`` for nulls, ties and
    empty tables.  Repeated rows are turns of their own; other columns play no part."""
    scratch = Scratch(conversations.sparkSession, "conversations")
    lists = scratch.write(turn_lists(conversations), "lists")
    return prefix_trie(keyed(rebuilt(lists)))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of an ASCII text in SQL: the table's entries and the text's bytes are folded with the standard's polynomial.
CRC32_SQL = r"""
crc_table AS (SELECT list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab
              FROM (SELECT unnest(range(0, 256)) AS n))
"""


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of an expression's UTF-8 bytes; needs ``crc_table`` in the FROM clause."""
    byte = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), "
            f"lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)")


OP12_SQL = rf"""
WITH RECURSIVE {CRC32_SQL.strip()},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS no
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t) x, crc_table),
turns AS (SELECT c.conv_id, 0 AS part, t.no, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.no <= c.h
          UNION ALL SELECT c.conv_id, 1, t.no, t.role, t.text FROM c JOIN t USING (conv_id) WHERE t.no > c.h),
numbered AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, no) AS d,
                    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, md5(role || chr(0) || text) AS one FROM turns),
steps AS (SELECT conv_id, 0 AS d, '' AS path, '' AS up, 0 AS w FROM c
          UNION ALL SELECT n.conv_id, s.d + 1, md5(s.path || n.one), s.path, n.w FROM steps s JOIN numbered n ON n.conv_id = s.conv_id AND n.d = s.d + 1),
sizes AS (SELECT conv_id, max(d) AS size FROM steps GROUP BY conv_id),
nodes AS (SELECT path, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
                 coalesce(string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
          FROM steps JOIN sizes USING (conv_id) GROUP BY path, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY up, d),
facts AS (SELECT nodes.*, coalesce(k, 0) AS k, (n - 1) * w AS own FROM nodes LEFT JOIN kids ON kids.up = nodes.path AND kids.d = nodes.d),
under AS (SELECT path, d, path AS top, d AS top_d, up AS next, k, own FROM facts
          UNION ALL SELECT u.path, u.d, f.path, f.d, f.up, u.k, u.own FROM under u JOIN facts f ON f.path = u.next AND f.d = u.top_d - 1),
sums AS (SELECT top, top_d, count(*) FILTER (WHERE k = 0) AS leaves, sum(own) AS saved FROM under GROUP BY top, top_d)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, CAST(f.k AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM facts f JOIN sums s ON s.top = f.path AND s.top_d = f.d LEFT JOIN facts p ON p.path = f.up AND p.d = f.d - 1
"""
