"""A uniform shuffle into shards of exact sizes, in DataFrame operations only.

1. Rows are dealt to source partitions by a hash of their content, about ``ROWS`` to
   each, and counted there.
2. A communication matrix (Gustedt 2008) says how many rows of each partition go to
   each shard: its rows sum to the partitions' sizes, its columns to the shards' exact
   sizes, and it is a draw from the distribution that a uniform permutation of all rows
   has. A tree over the partitions makes it in parallel: a node splits its column sums
   among 32 children by hypergeometric draws, one child and one shard after the other.
3. Each partition permutes its rows and gives the first ones to shard 0, the next ones
   to shard 1, and so on, as its row of the matrix says.
4. Each shard permutes what arrives: ``slot`` is the place there, from 0 without gaps.

A draw inverts the distribution function from the mode outwards, with weights relative
to the mode, so no factorials are needed; it stops 4.5 times the root of the draw's
size away, where less than 2^-53 is left (Hoeffding 1963). Shards differ by one row at
most (the law ``rows``). Slots are ranks inside buckets of each shard plus the sizes of
the buckets before, so no shard is sorted by one task.

All randomness is md5 of a seed and of id and text, so reruns agree. Rows equal in all
columns are one group that is counted and only then unfolded in blocks: copies of one
row, however many, are spread like others. Null ids and texts count as empty, an empty
table gives no rows, and every row of the input is in the result once. Copies of a text
under different ids are rows of their own. Columns named ``shard`` or ``slot`` are
replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.functions.vectors import once
from logwarden.llm.common import crc32_sql
from logwarden.session import stored

SHARDS = 8
RADIX_BITS = 5
ROWS = 1 << 14
LEAST_LEVELS = 2
SEED = "deal-1"
#: 2 exp(-2 h^2 / m) < 2^-53 at h = SPREAD sqrt(m)
SPREAD = 4.5
UNFOLD = 4096


def _md5(*parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def _leading(digest: Column, bits: int) -> Column:
    """The first ``bits`` bits of a digest."""
    digits = -(-bits // 4)
    return F.floor(F.conv(F.substring(digest, 1, digits), 16, 10).cast("long") / (1 << (4 * digits - bits))).cast("long")


def _uniform(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def hypergeometric(total: Column, good: Column, n: Column, u: Column) -> Column:
    """How many of ``n`` rows drawn from ``total`` are among ``good``, for a uniform ``u``."""
    names = ("total", "good", "n", "mode", "half", "u")
    t, g, d = (x.cast("double") for x in (total, good, n))
    mode = F.greatest(F.lit(0.0), d - (t - g), F.least(d, g, F.floor((d + 1) * (g + 1) / (t + 2)).cast("double")))
    half = F.ceil(SPREAD * F.sqrt(F.least(d, t - d, g, t - g))) + 2

    def found(x: Column) -> Column:
        total, good, n, mode, half, u = (x[c] for c in names)
        rest = total - good - n
        steps = F.sequence(F.lit(1).cast("long"), half)

        def up(w: Column, i: Column) -> Column:
            k = mode + (i - 1)
            return w * ((good - k) * (n - k) / ((k + 1) * (rest + k + 1)))

        def down(w: Column, i: Column) -> Column:
            k = mode - (i - 1)
            return w * (k * (rest + k) / ((good - k + 1) * (n - k + 1)))

        weigh = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), F.lit(1.0).alias("sum")),
            lambda a, i: once(
                F.struct(up(a["up"], i).alias("up"), down(a["down"], i).alias("down")),
                lambda w: F.struct(w["up"], w["down"], (a["sum"] + (w["up"] + w["down"])).alias("sum")),
            ),
            lambda a: a["sum"],
        )

        def search(start: Column) -> Column:
            return F.aggregate(
                steps,
                F.struct(
                    F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), start.alias("left"),
                    F.when(start < 0, mode).alias("at"),
                ),
                lambda a, i: F.when(a["at"].isNotNull(), a).otherwise(
                    once(
                        F.struct(up(a["up"], i).alias("up"), down(a["down"], i).alias("down")),
                        lambda w: F.struct(
                            w["up"], w["down"], (a["left"] - w["up"] - w["down"]).alias("left"),
                            F.when(a["left"] - w["up"] < 0, mode + i)
                            .when(a["left"] - w["up"] - w["down"] < 0, mode - i).alias("at"),
                        ),
                    )
                ),
                lambda a: F.coalesce(a["at"], mode).cast("long"),
            )

        return once(u * weigh - 1.0, search)

    packed = F.struct(*(c.alias(x) for c, x in zip((t, g, d, mode, half, u), names, strict=True)))
    return once(packed, found)


def _matrix_rows(sizes: Column, columns: Column, shards: int, tag: Column) -> Column:
    """An array with the row of the matrix for each child: its draws from the column sums."""
    empty = F.array().cast("array<bigint>")

    def row(rest: Column, n: Column, child: Column) -> Column:
        left = F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            F.struct(left.alias("total"), n.alias("n"), empty.alias("row")),
            lambda a, s: once(
                hypergeometric(a["total"], F.get(rest, s), a["n"], _uniform(_md5(tag, child.cast("string"), s.cast("string")))),
                lambda k: F.struct(
                    (a["total"] - F.get(rest, s)).alias("total"), (a["n"] - k).alias("n"),
                    F.concat(a["row"], F.array(k)).alias("row"),
                ),
            ),
            lambda a: a["row"],
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit((1 << RADIX_BITS) - 1)),
        F.struct(columns.alias("rest"), F.array().cast("array<array<bigint>>").alias("rows")),
        lambda a, j: once(
            row(a["rest"], F.get(sizes, j), j),
            lambda r: F.struct(
                F.zip_with(a["rest"], r, lambda x, y: x - y).alias("rest"), F.concat(a["rows"], F.array(r)).alias("rows")
            ),
        ),
        lambda a: a["rows"],
    )


def communication_matrix(counts: DataFrame, levels: int, shards: int = SHARDS) -> DataFrame:
    """part, row: how many rows of each partition go to each shard.

    ``counts`` holds ``part`` and ``c``, at most 32^levels small rows.
    """
    n = counts.agg(F.sum("c")).first()[0] or 0
    exact = [n // shards + (s < n % shards) for s in range(shards)]
    spark = counts.sparkSession
    nodes = spark.range(1).select(
        F.col("id").alias("node"), F.array(*(F.lit(x).cast("long") for x in exact)).alias("row")
    )
    fan = 1 << RADIX_BITS
    for level in range(levels):
        below = RADIX_BITS * (levels - level - 1)
        child = F.shiftright("part", below)
        sums = counts.groupBy(child.alias("child")).agg(F.sum("c").alias("c"))
        sizes = sums.groupBy(F.shiftright("child", RADIX_BITS).alias("node")).agg(
            F.map_from_entries(F.collect_list(F.struct((F.col("child") % fan).cast("int"), "c"))).alias("by")
        )
        filled = F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda j: F.coalesce(F.try_element_at("by", j), F.lit(0).cast("long")))
        split = nodes.join(sizes, "node").withColumn("sizes", filled)
        rows = _matrix_rows(F.col("sizes"), F.col("row"), shards, F.concat_ws("|", F.lit("tree"), F.lit(level), "node"))
        nodes = split.select("node", F.posexplode(rows).alias("j", "row")).select(
            (F.col("node") * fan + F.col("j")).alias("node"), "row"
        )
    return nodes.withColumnRenamed("node", "part")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _units(rows: DataFrame) -> DataFrame:
    """_doc, _unit, _rest: a row for each row, with a key that copies don't share.

    ``rows`` has _doc, _key and _rest; equal ones are counted and unfolded in blocks.
    """
    groups = rows.groupBy("_key", "_rest").agg(F.first("_doc").alias("_doc"), F.count("*").alias("_n"))
    blocks = groups.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / UNFOLD))))
    low = F.col("_block") * UNFOLD
    big = F.col("_n") > UNFOLD
    spread = blocks.where(~big).unionByName(blocks.where(big).repartition("_key", "_block"))
    return spread.select(
        "_doc", "_rest", F.col("_key"), F.explode(F.sequence(low + 1, F.least(low + UNFOLD, F.col("_n")))).alias("_copy")
    ).select("_doc", "_rest", _md5(F.lit("unit"), "_key", "_copy").alias("_unit"))


def _deal(rows: DataFrame, shards: int) -> DataFrame:
    """_doc, shard, slot."""
    keyed = stored(_units(rows), "deal-units")
    n = keyed.count()
    levels = LEAST_LEVELS
    while n > ROWS << (RADIX_BITS * levels):
        levels += 1
    bits = RADIX_BITS * levels
    placed = keyed.withColumn("part", _leading(F.col("_unit"), bits))
    counts = stored(placed.groupBy("part").agg(F.count("*").alias("c")), "deal-counts")
    matrix = stored(communication_matrix(counts, levels, shards), "deal-matrix")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(_md5(F.lit("local"), "_unit"), "_unit", "_rest"))
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda s: F.aggregate(F.slice("row", F.lit(1), s), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    again = _md5(F.lit("slot"), "_unit")
    sent = stored(
        placed.withColumn("rank", rank).join(matrix.select("part", ends.alias("ends")), "part").select(
            "_doc", "_unit", "_rest", shard.alias("shard"), _leading(again, bits).alias("bucket")
        ),
        "deal-sent",
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "bucket").agg(F.count("*").alias("c")).select(
        "shard", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "bucket").orderBy(again, "_unit", "_rest")
    return sent.withColumn("r", F.row_number().over(within)).join(starts, ["shard", "bucket"]).select(
        "_doc", "shard", (F.col("start") + F.col("r") - 1).cast("long").alias("slot")
    )


def deal(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [F.to_json(F.struct(f.name)) if _has_map(f.dataType) else F.col(f.name) for f in docs.schema.fields]
    rows = docs.select(
        F.struct("*").alias("_doc"),
        _md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)).alias("_key"),
        F.xxhash64(*parts).alias("_rest"),
    )
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return _deal(rows, shards).select(*(F.col("_doc")[c].alias(c) for c in kept), "shard", "slot")


def write_shards(dealt: DataFrame, path: str, rows: int = 1 << 20) -> None:
    """One folder a shard, its files of about ``rows`` rows in the order of the slots."""
    piece = F.floor(F.col("slot") / rows)
    dealt.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.md5(text).alias("_md5"),
    )
    rows = small.select(
        F.struct("doc_id", "size", "text_crc32").alias("_doc"),
        _md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_md5").alias("_key"),
        F.xxhash64("doc_id", "size", "text_crc32").alias("_rest"),
    )
    return _deal(rows, SHARDS).select(
        "_doc.doc_id", "_doc.size", "_doc.text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def _draw_sql() -> tuple[str, str]:
    """The draw of :func:`hypergeometric` for DuckDB: the sum of the weights, and the search from l on.

    Columns: t, g, d (total, good, n), m (mode), h (half), l.
    """
    k = "(m + (b.i - 1))"
    up = f"a.up * ((g - {k}) * (d - {k}) / (({k} + 1) * (t - g - d + {k} + 1)))"
    k = "(m - (b.i - 1))"
    down = f"a.down * ({k} * (t - g - d + {k}) / ((g - {k} + 1) * (d - {k} + 1)))"
    none = "null::double"

    def state(i: str, up: str, down: str, x: str, at: str) -> str:
        return f"{{'i': {i}, 'up': {up}, 'down': {down}, 'x': {x}, 'at': {at}}}"

    zero, one = "0.0::double", "1.0::double"
    steps = f"list_transform(range(1, h + 1), lambda i: {state('i::double', zero, zero, zero, none)})"
    total = (
        f"list_reduce([{state(zero, one, one, one, none)}] || {steps}, "
        f"lambda a, b: {state('b.i', up, down, f'a.x + ({up} + {down})', none)}).x"
    )
    at = f"case when a.x - {up} < 0 then m + b.i when a.x - {up} - {down} < 0 then m - b.i end"
    search = (
        f"list_reduce([{state(zero, one, one, 'l', 'case when l < 0 then m end')}] || {steps}, "
        f"lambda a, b: case when a.at is not null then a else {state('b.i', up, down, f'a.x - {up} - {down}', at)} end).at"
    )
    return total, search


def _oracle() -> str:
    total, search = _draw_sql()
    levels, fan = LEAST_LEVELS, 1 << RADIX_BITS
    bits = RADIX_BITS * levels
    digits = -(-bits // 4)
    lead = lambda x: f"(('0x' || substr({x}, 1, {digits}))::bigint // {1 << (4 * digits - bits)})"
    key = lambda *parts: f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))"
    row_key = key("coalesce(doc_id::varchar, '')", "md5(coalesce(text, ''))")
    ctes = [
        f"p as (select doc_id, coalesce(text, '') x, {key(repr('unit'), row_key, '1')} u from documents)",
        f"q as (select *, {lead('u')} part, {key(repr('slot'), 'u')} v from p)",
        "cn as (select part, count(*) c from q group by part), al as (select count(*) n from q)",
        f"n0 as (select 0::bigint node, list_transform(range({SHARDS}), lambda s: "
        f"n // {SHARDS} + case when s < n % {SHARDS} then 1 else 0 end) as cols from al)",
    ]
    for level in range(levels):
        below = RADIX_BITS * (levels - level - 1)
        tag = f"'tree|{level}|' || node"
        ctes += [
            f"z{level} as (select node, any_value(cols) cols, list(size order by j) sizes from (select node, cols, j, "
            f"(select coalesce(sum(c), 0)::bigint from cn where (part >> {below}) = node * {fan} + j) size "
            f"from n{level}, (select unnest(range({fan})) j)) group by node)",
            # one draw a step, for child j and shard s: d of the t rows of shards s and after
            f"""r{level} as (
select node, sizes, cols rest, 0 j, 0 s, sizes[1] dd, list_sum(cols)::bigint tt, []::bigint[] done, null::bigint[] made from z{level}
union all
select node, sizes,
  case when fin then list_transform(range(1, {SHARDS + 1}), lambda y: rest[y] - now[y]) else rest end,
  case when fin then j + 1 else j end, case when fin then 0 else s + 1 end,
  case when fin then coalesce(sizes[j + 2], 0) else dd - now[s + 1] end,
  case when fin then list_sum(rest)::bigint - list_sum(now)::bigint else tt - rest[s + 1] end,
  case when fin then [] else now end, case when fin then now end
from (select *, list_append(done, coalesce({search}, m)::bigint) now, s = {SHARDS - 1} fin
from (select *, w * ({total}) - 1.0 l
from (select *, greatest(0.0, d - (t - g), least(d, g, floor((d + 1) * (g + 1) / (t + 2)))) m,
  (ceil({SPREAD}::double * sqrt(least(d, t - d, g, t - g))) + 2)::bigint h
from (select *, tt::double t, dd::double d, rest[s + 1]::double g,
  ('0x' || substr({key(tag, 'j', 's')}, 1, 13))::bigint::double / 4503599627370496.0::double w
from r{level} where j < {fan})))))""",
            f"n{level + 1} as (select node * {fan} + (j - 1) node, made cols from r{level} where made is not null)",
        ]
    return f"""with recursive {", ".join(ctes)},
m as (select node part, list_transform(range(1, {SHARDS + 1}), lambda s: list_sum(cols[1:s])::bigint) ends from n{levels}),
k as (select *, row_number() over (partition by part order by {key(repr('local'), 'u')}) r from q),
w as (select doc_id, x, v, len(list_filter(ends, lambda e: e < r))::int shard from k join m using (part))
select doc_id, (strlen(x) + 1)::bigint size, {crc32_sql('x')} text_crc32, 'rows' law, shard,
  (row_number() over (partition by shard order by {lead('v')}, v) - 1)::bigint slot, null::int grown_shard from w
"""


ORACLE_SQL = _oracle()
