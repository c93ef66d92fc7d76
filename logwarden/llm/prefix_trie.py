"""A trie of the prefixes that conversations share, from sorted sequences and range minima.

1. A turn is a digest of role and text with its number of words; a conversation is the
   array of its turns in order (null turn numbers first, ties by digest).
2. Conversations are sorted by their arrays, then by id, in ranges over the cluster.
   A task reads its range in runs of about ``RUN_TURNS`` turns.
3. In a run the common prefix lengths of neighbours go into a sparse table of range
   minima. Every candidate prefix, a row and a depth, finds how far to the left and to
   the right all neighbours share it by a binary search in that table, on its own and
   without a stack. The interval is the prefix' members in the run; the first member
   reports it, with the least id from a second sparse table.
4. Prefixes that cross the edges of runs are put together by their 128-bit hash.
5. The totals of subtrees need no walk through the depths. A node belongs to its least
   member, and a conversation's nodes are its deepest ones. A subtree's total is what
   all its members own, by running sums over the same intervals, less what the least
   member owns above it.

A node's id is its least member and its depth. ``ends_sha256`` is the digest of all ids
that end in a node; they come as sorted blocks of ``IDS`` ids and are hashed as a stream,
never held at once. Nodes whose children make up a thousandth of all nodes are at most
1,000; these alone are broadcast to name the parents, the others are joined.

Null roles and texts count as empty. Rows without a conversation id belong to no
conversation and take no part. Rows that repeat are turns of their own. A conversation
without turns ends in the root; no conversations give no nodes. Extra columns are
ignored. A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import STEP, crc32_sql, mixed_bits
from logwarden.session import stored

RUN_TURNS = 100_000
IDS = 4_096
UNIT = 20
RANGE_TURNS = 16
HOT_SHARE = 1_000
BASE, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "h1", "h2"]


def sequences(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """id, units: a row for each conversation, with 16 bytes of digest and 4 of word count for each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0"))
    turns = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), F.concat(digest, words).alias("unit")
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "unit")))
    return turns.groupBy("id").agg(F.transform(ordered, lambda t: t["unit"]).alias("units"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first 0 to 3 turns taken from the one whose id is the multiple of 20 below."""
    base = F.col("id") - F.col("id") % BASE
    heads = convs.where(F.col("id") % BASE == 0).select(
        F.col("id").alias("base"), F.slice("units", 1, HEADS - 1).alias("head")
    )
    h = (F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % HEADS).cast("int")
    own = F.slice("units", F.col("h") + 1, F.size("units") + 1)
    taken = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    return convs.withColumns({"base": base, "h": h}).join(heads, "base", "left").select(
        "id", F.concat(taken, own).alias("units")
    )


# ------------------------------------------------------------------ runs of sorted rows
def _runs(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """ids, lengths, units (as rows of five 4-byte numbers) and extra columns of each run."""
    parts: list[tuple] = []
    size = 0
    for batch in batches:
        lengths = batch.column("units").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths + 1)
        cuts = [0, *(np.flatnonzero(np.diff(ends // RUN_TURNS)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(a, b - a)
            flat = piece.column("units").flatten().cast(pa.large_binary())
            offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else [0, 0]
            data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            parts.append((
                piece.column("id").to_numpy(), lengths[a:b], data.reshape(-1, UNIT).copy(),
                *(piece.column(c).to_numpy() for c in extra),
            ))
            size += int(ends[b - 1] - (ends[a - 1] if a else 0))
            if size >= RUN_TURNS:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    ids, lengths, units, *extra = (np.concatenate(x) for x in zip(*parts, strict=True))
    return ids, lengths, np.ascontiguousarray(units).view("<u4"), extra


def common_lengths(lengths: np.ndarray, units: np.ndarray) -> np.ndarray:
    """How many first turns each row shares with the next one."""
    both = np.minimum(lengths[:-1], lengths[1:])
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
    same = (units[np.repeat(starts[:-1], both) + at] == units[np.repeat(starts[1:], both) + at]).all(1)
    out = both.copy()
    pair = np.repeat(np.arange(len(both)), both)[~same]
    np.minimum.at(out, pair, at[~same])
    return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the least of each 2^k values in a row."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        last, step = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(last[:-step], last[step:]))
    return table


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share ``depth`` turns with ``row``: a binary search a side for each candidate."""
    left, right, n = row.copy(), row.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        step, level = 1 << k, table[k]
        if not len(level):
            continue
        to = left - step
        left = np.where((to >= 0) & (level[np.maximum(to, 0)] >= depth), to, left)
        ok = (right + step <= n) & (level[np.minimum(right, len(level) - 1)] >= depth)
        right = np.where(ok, right + step, right)
    return left, right


def range_least(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.empty(len(left), table[0].dtype)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][left[at]], table[k][right[at] - (1 << int(k)) + 1])
    return out


def _intervals(lengths: np.ndarray, units: np.ndarray) -> dict[str, np.ndarray]:
    """row, last, depth and the keys of every prefix of the run, and ``lcp``."""
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(starts, lengths)
    lcp = common_lengths(lengths, units)
    table = sparse_table(lcp)
    left, right = extents(table, row, place + 1)
    first = np.flatnonzero(left == row)
    keys = {}
    words = units[:, 0:2].copy().view("<u8")[:, 0], units[:, 2:4].copy().view("<u8")[:, 0]
    at = mixed_bits((place + 1).astype(np.uint64) * STEP)
    for name, digest in zip(("1", "2"), words, strict=True):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed_bits(digest ^ at), dtype=np.uint64)])
        begin = np.repeat(sums[starts], lengths)
        keys["h" + name], keys["p" + name] = (sums[1:] - begin)[first], (sums[:-1] - begin)[first]
    zero = np.zeros(1, np.uint64)
    out = {k: np.concatenate([zero, v]).view(np.int64) for k, v in keys.items()}
    return out | {
        "row": np.concatenate([[0], row[first]]), "last": np.concatenate([[len(lengths) - 1], right[first]]),
        "depth": np.concatenate([[0], place[first] + 1]), "lcp": lcp,
        "words": np.concatenate([[0], units[first, 4].byteswap().astype(np.int64)]),
    }


MEMBERS = "depth long, h1 long, h2 long, p1 long, p2 long, n long, id long, words long, ids string"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of a run, and blocks of the ids that end in a prefix."""
    for ids, lengths, units, _ in _runs(batches, []):
        x = _intervals(lengths, units)
        least = range_least(sparse_table(ids), x["row"], x["last"])
        names = ["depth", "h1", "h2", "p1", "p2", "n", "id", "words", "ids"]
        columns = [x["depth"], x["h1"], x["h2"], x["p1"], x["p2"], x["last"] - x["row"] + 1, least, x["words"]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(least), pa.string())], names)
        # equal rows are neighbours, and a node's first members are those that end in it
        equal = (x["lcp"] == lengths[:-1]) & (x["lcp"] == lengths[1:])
        begins = np.concatenate([[0], np.flatnonzero(~equal) + 1])
        begins = np.concatenate([np.arange(a, b, IDS) for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)])
        ends = [*begins[1:].tolist(), len(ids)]
        # a whole row's node has its length and begins at the first row that equals it
        at = {(r, d): i for i, (r, d) in enumerate(zip(x["row"].tolist(), x["depth"].tolist(), strict=True))}
        group = np.zeros(len(ids), np.int64)
        group[1:] = np.where(equal, 0, np.arange(1, len(ids)))
        group = np.maximum.accumulate(group)
        node = [at[(int(group[b]), int(lengths[b]))] if lengths[b] else 0 for b in begins]
        text = ids.astype(str)
        blocks = [",".join(text[a:b]) for a, b in zip(begins.tolist(), ends, strict=True)]
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[k][node]) for k in ("depth", "h1", "h2")]
            + [none, none, pa.array(np.array(ends) - begins), pa.array(ids[begins]), none, pa.array(blocks, pa.string())],
            names,
        )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the members of each prefix of a run own."""
    for _, lengths, units, extra in _runs(batches, ["leaves", "tokens"]):
        x = _intervals(lengths, units)
        out = []
        for values in extra:
            upto = np.concatenate([[0], np.cumsum(values)])
            out.append(pa.array(upto[x["last"] + 1] - upto[x["row"]]))
        yield pa.RecordBatch.from_arrays([pa.array(x[k]) for k in KEY] + out, [*KEY, "leaves", "tokens"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key of blocks that come sorted by key and first id."""
    now, state, n = None, None, 0

    def row() -> pa.RecordBatch:
        columns = [[x] for x in (*now, state.hexdigest(), n)]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.int64())],
            [*KEY, "ends_sha256", "n_ends"],
        )

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for *key, ids, many in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids", "n")), strict=True):
            if key != now:
                if now is not None:
                    done.append(row())
                now, state, n = key, hashlib.sha256(), 0
            elif n:
                state.update(b",")
            state.update(ids.encode())
            n += many
        yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
    if now is not None:
        yield row()


def _sorted_map(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    ranged = rows.repartitionByRange(F.slice("units", 1, RANGE_TURNS), "id")
    return ranged.sortWithinPartitions("units", "id").mapInArrow(run, schema)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``convs`` (id, units as :func:`sequences` makes them).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, n_ends, ends_sha256
    and saved_tokens, the words that members need not repeat, over the whole subtree.
    """
    convs = stored(convs, "trie-sequences")
    found = stored(_sorted_map(convs, _members, MEMBERS), "trie-members")
    merged = found.where("ids is null").groupBy(*KEY).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.sum("n").alias("n_convs"),
        F.min("id").alias("conv_id"), F.max("words").alias("words"),
    )
    merged = stored(merged, "trie-merged")
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
        F.count("*").alias("n_children")
    )
    own = Window.partitionBy("conv_id").orderBy("depth")
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    nodes = (
        merged.join(children, KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumns({
            "leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"),
            "own": (F.col("n_convs") - 1) * F.col("words"),
        })
        .withColumns({
            "leaves_above": F.coalesce(F.sum("leaf").over(above), F.lit(0)),
            "tokens_above": F.coalesce(F.sum("own").over(above), F.lit(0)),
            "parent_conv_id": F.lag("conv_id").over(own),
        })
    )
    nodes = stored(nodes, "trie-nodes")
    owned = nodes.groupBy(F.col("conv_id").alias("id")).agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("tokens"))
    weighted = convs.join(owned, "id", "left").select(
        "id", "units", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("leaves", "tokens"))
    )
    sums = _sorted_map(stored(weighted, "trie-weighted"), _sums, "depth long, h1 long, h2 long, leaves long, tokens long").groupBy(*KEY).agg(
        F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens")
    )
    blocks = found.where("ids is not null").select(*KEY, "id", "ids", "n")
    ends = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "id").mapInArrow(
        _digests, "depth long, h1 long, h2 long, ends_sha256 string, n_ends long"
    )
    whole = _with_parents(nodes).join(sums, KEY).join(ends, KEY, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") - F.col("leaves_above")).alias("n_leaves"),
        (F.col("tokens") - F.col("tokens_above")).alias("saved_tokens"),
        F.coalesce("n_ends", F.lit(0).cast("long")).alias("n_ends"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Fills in ``parent_conv_id`` where the parent belongs to another conversation."""
    total = nodes.count()
    parents = nodes.where("n_children > 0").select(
        F.col("h1").alias("p1"), F.col("h2").alias("p2"), (F.col("depth") + 1).alias("depth"),
        F.col("conv_id").alias("named"), "n_children",
    )
    key = ["depth", "p1", "p2"]
    is_hot: Column = F.col("n_children") * HOT_SHARE >= total
    known = nodes.where("parent_conv_id is not null or depth = 0")
    open_ = nodes.where("parent_conv_id is null and depth > 0").drop("parent_conv_id")
    hot = open_.join(F.broadcast(parents.where(is_hot).drop("n_children")), key, "left")
    rest = hot.where("named is null").drop("named").join(parents.where(~is_hot).drop("n_children"), key)
    filled = hot.where("named is not null").unionByName(rest).withColumnRenamed("named", "parent_conv_id")
    return known.unionByName(filled)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(rebuilt(sequences(turns)))


ORACLE_SQL = f"""
with t as (select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) u,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint w from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, u) k from t),
c as (select conv_id, n, x - x // {HEADS} * {HEADS} h, conv_id - conv_id % {BASE} base
  from (select conv_id, n, {crc32_sql('conv_id::varchar')} x from (select conv_id, count(*) n from o group by conv_id))),
r as (select c.conv_id, o.k pos, u, w from c join o on o.conv_id = c.base and o.k <= c.h
  union all select c.conv_id, least(c.h, coalesce(b.n, 0)) + o.k - c.h, u, w
  from c join o on o.conv_id = c.conv_id and o.k > c.h left join c b on b.conv_id = c.base),
cells as (select conv_id, pos d, array_to_string(list(u) over (partition by conv_id order by pos
  rows between unbounded preceding and current row), '') path, w from r union all select conv_id, 0, '', 0 from c),
nodes as (select d, path, min(conv_id) conv_id, count(*) n_convs, max(w) w from cells group by d, path),
full_ as (select a.*, p.conv_id parent_conv_id, coalesce(k.n, 0) n_children from nodes a
  left join nodes p on p.d = a.d - 1 and p.path = substr(a.path, 1, 32 * (a.d - 1)::int)
  left join (select d - 1 d, substr(path, 1, 32 * (d - 1)::int) path, count(*) n from nodes where d > 0 group by all) k
  on k.d = a.d and k.path = a.path),
below as (select a d, substr(path, 1, 32 * a::int) path, sum((n_children = 0)::int) n_leaves, sum((n_convs - 1) * w) saved
  from (select *, unnest(range(d + 1)) a from full_) group by all),
last_ as (select conv_id, max(d) d, arg_max(path, d) path from cells group by conv_id),
ends as (select d, path, count(*) n_ends, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) s from last_ group by all)
select conv_id, d::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves::bigint n_leaves, saved::bigint saved_tokens,
  coalesce(n_ends, 0) n_ends, coalesce(s, sha256('')) ends_sha256
from full_ join below using (d, path) left join ends using (d, path)
"""
