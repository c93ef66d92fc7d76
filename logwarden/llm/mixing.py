"""Mixing sources to target weights, in DataFrame operations only.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share the
words of the corpus. A target stops at three times its source; what is cut off is
shared by weight among the others until none is above.

Each source is a stream: its documents in a keyed permutation, passed over up to
three times, and cut where the target is reached; a document belongs to it if its
middle does, so a source is off by half a document at most. The stream is counted
in blocks of about 1/16384 of the mix. A multivariate-hypergeometric splitting
tree deals the blocks of all sources among the output shards: at each node the
blocks are ranked by a hash and the left half is the lower half, so the count of
each source on a side is a draw without replacement, and all quotas come out
exactly. Each shard then takes as many blocks as its quota from the source's
permuted blocks, and is shuffled locally by a hash of document and pass.

Running sums go over buckets of the permutation, so a source that holds most rows
is still many small groups. Documents without words are never taken. Null texts
have no words; null sources are one source; repeated rows are documents of their
own. Reruns give the same rows. Other columns are kept, but for ones named ``pass``,
``shard`` or ``place``. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.session import stored

WEIGHTS = (5, 2, 1)
MOST = 3
SHARD_LEVELS = 4
BLOCKS = 16384
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["_src", "_none"]


def with_sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Each row as ``_doc``, its number of words, its place in the permutation and its source's key."""
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.col(source_col)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("_doc"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
        F.md5(F.concat_ws("|", F.lit(SEED), ident, F.md5(text))).alias("_key"),
        F.coalesce(source, F.lit("")).alias("_src"),
        source.isNull().alias("_none"),
    ).withColumn("_bucket", F.substring("_key", 1, 3))


def source_targets(sized: DataFrame) -> DataFrame:
    """A row per source: its words and its target.

    The capped sources are the first ones by size per weight; the rest share what
    is left at one rate.
    """
    sizes = sized.groupBy(*SOURCE).agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy("_none", "_src")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    cap = MOST * F.col("source_size")
    full = Window.orderBy(cap / F.col("weight"), "_none", "_src")
    below = full.rowsBetween(Window.unboundedPreceding, -1)
    every = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(below), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    rates = sizes.withColumn("weight", weight).withColumns(
        {"rate": left / rest, "place": F.row_number().over(full)}
    )
    # the first source that stays below its cap sets the rate of all after it
    open_rate = F.min(F.when(cap >= F.col("rate") * F.col("weight"), F.struct("place", "rate"))).over(every)
    share = F.col("weight") * open_rate["rate"]
    return rates.withColumn("target", F.least(cap.cast("double"), share)).select(
        *SOURCE, "source_size", "target"
    )


def _permuted(*parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def shard_blocks(targets: DataFrame, levels: int = SHARD_LEVELS, blocks: int = BLOCKS) -> DataFrame:
    """_src, _none, block, shard: the splitting tree over about ``blocks`` blocks."""
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    width = F.greatest(F.lit(1), F.ceil(F.sum("target").over(total) / blocks)).cast("long")
    units = (
        targets.withColumn("width", width)
        .withColumn("n", F.ceil(F.col("target") / F.col("width")).cast("int"))
        .where("n > 0")
        .select(*SOURCE, "width", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    )
    tree = units.withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(_permuted(F.lit(f"tree{level}"), *SOURCE, "block"), *SOURCE, "block"))
        half = F.floor((F.count("*").over(node) + 1) / 2)
        tree = tree.withColumns({"rank": rank, "half": half}).withColumn(
            "shard", F.col("shard") * 2 + F.when(F.col("rank") <= F.col("half"), 0).otherwise(1)
        )
    own = Window.partitionBy(*SOURCE)
    quotas = tree.withColumn("draw", F.row_number().over(own.orderBy("shard", "block")))
    drawn = units.withColumn(
        "draw", F.row_number().over(own.orderBy(_permuted(F.lit("draw"), *SOURCE, "block"), "block"))
    )
    return drawn.join(quotas.select(*SOURCE, "draw", "shard"), [*SOURCE, "draw"]).select(
        *SOURCE, "block", "width", "shard"
    )


def taken_passes(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``_passes``, the passes that take a document."""
    bucket = [*SOURCE, "_bucket"]
    sums = sized.groupBy(*bucket).agg(F.sum("_size").alias("words"))
    before = Window.partitionBy(*SOURCE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(targets, SOURCE)
        .select(*bucket, "start", "source_size", "target")
    )
    within = Window.partitionBy(*bucket).orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda p: p * F.col("source_size") + F.col("_at")
    passes = F.filter(
        F.array(*(F.struct(F.lit(p).alias("pass"), at(p).alias("at")) for p in range(MOST))),
        lambda p: (F.col("_size") > 0) & (p["at"] + F.col("_size") / 2 <= F.col("target")),
    )
    return (
        sized.join(starts, bucket)
        .withColumn("_at", F.col("start") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .withColumn("_passes", passes)
        .drop("start", "_at", "_bucket")
    )


def mix(docs: DataFrame, levels: int = SHARD_LEVELS, **columns: str) -> DataFrame:
    """The mix: a row per taken document and pass, with ``shard`` and ``place``.

    To write it, sort each shard by ``place``: the local shuffle.
    """
    sized = with_sizes(docs, **columns)
    mixed = _mix(sized, stored(source_targets(sized), "mix-targets"), "_doc", levels)
    added = ["pass", "shard", "place"]
    return mixed.select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c not in added), *added)


def _mix(sized: DataFrame, targets: DataFrame, kept: str, levels: int) -> DataFrame:
    blocks = stored(shard_blocks(targets, levels), "mix-blocks")
    width = blocks.select("width").limit(1).collect()  # one number
    rows = taken_passes(sized, targets).select("*", F.explode("_passes").alias("_p"))
    width = width[0][0] if width else 1
    rows = rows.withColumns({"block": F.floor(F.col("_p.at") / width).cast("int"), "pass": F.col("_p.pass")})
    return rows.join(blocks.drop("width"), [*SOURCE, "block"]).select(
        kept, "pass", "shard", _permuted(F.lit("place"), "shard", "_key", "pass").alias("place")
    )


def _tree_sql(levels: int) -> str:
    """CTEs t0 ... tN: the splitting tree, for DuckDB."""
    key = lambda tag: f"md5(concat_ws('|', '{SEED}', '{tag}', _src, _none, block))"
    steps = ["t0 as (select *, 0 shard from u)"]
    for n in range(levels):
        steps.append(
            f"t{n + 1} as (select * exclude (shard), shard * 2 + case when row_number() over "
            f"(partition by shard order by {key(f'tree{n}')}, _src, _none, block) <= "
            f"(count(*) over (partition by shard) + 1) // 2 then 0 else 1 end shard from t{n})"
        )
    steps.append(
        f"q as (select *, row_number() over (partition by _src, _none order by shard, block) draw from t{levels})"
    )
    steps.append(
        f"b as (select u.*, q.shard from (select *, row_number() over (partition by _src, _none "
        f"order by {key('draw')}, block) draw from u) u join q using (_src, _none, draw))"
    )
    return ", ".join(steps)


ORACLE_SQL = f"""
with d as (select doc_id, source, coalesce(source, '') _src, source is null _none,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint size,
  md5(concat_ws('|', '{SEED}', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))) k from documents),
s as (select _src, _none, sum(size)::bigint n,
  [{",".join(map(str, WEIGHTS))}][(row_number() over (order by _none, _src) - 1) % {len(WEIGHTS)} + 1] w
  from d group by _src, _none),
o as (select a.n * {MOST} / a.w ratio,
  ((select sum(n) from s) - coalesce(sum({MOST} * b.n) filter ({MOST} * b.n / b.w < {MOST} * a.n / a.w), 0))
  / sum(b.w) filter ({MOST} * b.n / b.w >= {MOST} * a.n / a.w) rate from s a, s b group by a._src, a._none, a.n, a.w),
t as (select _src, _none, n source_size,
  least({MOST}.0 * n, w * (select arg_min(rate, ratio) from o where ratio >= rate)) target from s),
wd as (select greatest(1, ceil(sum(target) / {BLOCKS}))::bigint width from t),
u as (select _src, _none, unnest(range(ceil(target / width)::bigint)) block from t, wd),
{_tree_sql(SHARD_LEVELS)},
c as (select *, sum(size) over (partition by _src, _none order by k, size rows between unbounded preceding
  and current row) - size pos from d join t using (_src, _none)),
p as (select *, p * source_size + pos as at_ from c, (select unnest(range({MOST})) p)
  where size > 0 and p * source_size + pos + size / 2.0 <= target),
x as (select p.doc_id, k, size, count(*) n, string_agg(b.shard, ',' order by p) shards
  from p, wd join b on b._src = p._src and b._none = p._none and b.block = p.at_ // width group by all)
select c.doc_id, c.size, source_size::bigint source_size, round(target, 6) target,
  (c.size * coalesce(n, 0))::bigint taken, coalesce(shards, '') shards
from c left join x on c.doc_id is not distinct from x.doc_id and c.k = x.k and c.size = x.size
"""


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = with_sizes(docs).withColumns({"doc_id": F.col("_doc.doc_id"), "row": F.monotonically_increasing_id()})
    sized = stored(rows.drop("_doc"), "mix-sizes")
    targets = stored(source_targets(sized), "mix-targets")
    mixed = _mix(sized, targets, "row", SHARD_LEVELS)
    shards = mixed.groupBy("row").agg(
        F.count("*").alias("times"), F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("p")
    )
    words = F.col("_size") * F.coalesce("times", F.lit(0))
    return (
        sized.join(shards, "row", "left")
        .join(targets, SOURCE)
        .select(
            "doc_id",
            F.col("_size").alias("size"),
            "source_size",
            F.round("target", 6).alias("target"),
            words.cast("long").alias("taken"),
            F.coalesce(F.array_join(F.transform("p", lambda x: x["shard"].cast("string")), ","), F.lit("")).alias("shards"),
        )
    )
