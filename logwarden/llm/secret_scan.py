"""Secret scan with multipart credential linking, in DataFrame operations only.

Base findings (reported always): ``assign``, ``access`` and ``hex``. Weak
candidates (reported only in company): ``ident`` (user names, client ids, mail
addresses), ``endpoint`` (URLs, IPv4 addresses) and ``opaque`` (long mixed-case
tokens). A weak candidate is reported if within its scope, that is fewer than
``scope`` code points away in the same text, there is a base finding of another
role, or weak candidates of both other roles. Roles: identifier (access, ident),
secret (assign, hex, opaque), endpoint.

The interval join puts every part into the cells of ``scope`` code points that it
touches and keeps, for each cell and role, the first start and the last end. A
candidate meets at most the cells it touches and one on either side, so the join
has a few rows for each candidate, however many parts share a cell.

Null and empty texts have no spans. Rows are told apart by a row number, so null
or repeated ids and repeated texts each keep their own row. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.session import stored

SCOPE = 256
KINDS = ("assign", "access", "hex", "ident", "endpoint", "opaque")
N_BASE = 3
# The patterns of the base kinds, and of the weak ones.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
IDENT = (
    r"""(?i)\b(?:user|username|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,64}"""
    # one flat class for the labels: a repeated group would take a stack frame for each of them
    r"""|\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{0,190}[A-Za-z0-9]"""
)
ENDPOINT = (
    r"""\b(?:https?|ftp|ssh|jdbc:[a-z0-9]{1,20}|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
    r"""|\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b(?::[0-9]{1,5})?"""
)
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
PATTERNS = (ASSIGN, ACCESS, HEX, IDENT, ENDPOINT, OPAQUE)
SPAN = "array<struct<start:int,kind:int,end:int>>"

#: role columns of a cell: strong and weak identifiers, strong and weak secrets, endpoints
ROLES = {"id": (1,), "wid": (3,), "sec": (0, 2), "wsec": (5,), "site": (4,)}


def _parts(text: Column, kind: int) -> Column:
    """Lengths of the gaps and of the hits of one kind, null if there is none."""
    p = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(text, p, F.lit(0))
    if kind == 0:
        kept = F.transform(F.regexp_extract_all(text, p, F.lit(2)), lambda v: F.length(v) >= 8)
    elif kind == 5:
        kept = F.transform(
            hits, lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
        )
    else:
        kept = F.transform(hits, lambda v: F.lit(True))
    found = F.struct(
        F.lit(kind).alias("kind"),
        F.arrays_zip(
            F.transform(F.split(text, PATTERNS[kind], -1), F.length).alias("gap"),
            F.transform(hits, F.length).alias("hit"),
            kept.alias("kept"),
        ).alias("runs"),
    )
    return F.when(text.rlike(PATTERNS[kind]), found)


def _spans(rows: DataFrame) -> DataFrame:
    """row, kind, start, end: positions are running sums of gaps and hits."""
    runs = rows.select("row", F.explode("parts").alias("p")).select(
        "row", "p.kind", F.posexplode("p.runs").alias("i", "r")
    )
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("r.gap") + F.coalesce(F.col("r.hit"), F.lit(0))
    start = (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.col("r.gap")).cast("int")
    return (
        runs.withColumn("start", start)
        .where("r.hit is not null and r.kept")
        .select("row", "kind", "start", (F.col("start") + F.col("r.hit")).cast("int").alias("end"))
    )


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans whose complementary parts lie within the scope."""
    cell = lambda c: (F.floor(F.col(c) / scope)).cast("int")
    last = (F.floor((F.col("end") - 1) / scope)).cast("int")
    touched = spans.withColumn("cell", F.explode(F.sequence(cell("start"), last)))
    of = lambda kinds: F.col("kind").isin(*kinds)
    cells = touched.groupBy("row", "cell").agg(
        *(F.min(F.when(of(k), F.col("start"))).alias(f"{r}_from") for r, k in ROLES.items()),
        *(F.max(F.when(of(k), F.col("end"))).alias(f"{r}_to") for r, k in ROLES.items()),
    )
    weak = spans.where(F.col("kind") >= N_BASE).withColumns({"first": cell("start"), "last": last})
    met = weak.withColumn(
        "cell", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1))
    ).join(cells, ["row", "cell"])

    def near(role: str) -> Column:
        return F.max(
            F.when(F.col("cell") < F.col("first"), F.col(f"{role}_to") > F.col("start") - scope)
            .when(F.col("cell") > F.col("last"), F.col(f"{role}_from") < F.col("end") + scope)
            .otherwise(F.col(f"{role}_from").isNotNull())
        )

    seen = met.groupBy("row", "kind", "start", "end").agg(
        *(F.coalesce(near(r), F.lit(False)).alias(r) for r in ROLES)
    )
    secret, ident, site = F.col("sec") | F.col("wsec"), F.col("id") | F.col("wid"), F.col("site")
    complete = (
        F.when(F.col("kind") == 3, F.col("sec") | (secret & site))
        .when(F.col("kind") == 4, F.col("sec") | F.col("id") | (secret & ident))
        .otherwise(F.col("id") | (ident & site))
    )
    return seen.where(complete).select("row", "kind", "start", "end")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE
) -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, sorted by start and kind.

    ``spans`` is an array of (start, kind, end), in code points, end exclusive; kind
    is a place in ``KINDS``. The scan result, without texts, is stored once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.array(*(_parts(F.col("t"), k) for k in range(len(KINDS))))
    scanned = stored(
        docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.filter(kinds, lambda p: p.isNotNull()).alias("parts"),
        ),
        "secret-parts",
    )
    spans = _spans(scanned.where(F.size("parts") > 0))
    kept = spans.where(F.col("kind") < N_BASE).unionByName(_linked(spans, scope))
    lists = kept.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")
    )
    return scanned.join(lists, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("spans", F.array().cast(SPAN)).alias("spans"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the query."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < N_BASE)
    return found.select(
        id_col,
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(N_BASE)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def _sql() -> str:
    """The same result by direct comparison of the parts of a text, for DuckDB."""
    strip = lambda p: p.replace("(?<![0-9a-f])", "").replace("(?<![A-Za-z0-9+/_-])", "")
    text = lambda p: "'" + strip(p).replace("'", "''") + "'"
    runs = []
    for k, p in enumerate(PATTERNS):
        kept = f"regexp_extract_all(t, {text(p)}, 2)" if k == 0 else f"regexp_extract_all(t, {text(p)}, 0)"
        runs.append(
            f"""select row, {k} kind, unnest(range(len(hits))) i, unnest(hits) hit, unnest(vals) val, gaps
            from (select row, regexp_extract_all(t, {text(p)}, 0) hits, {kept} vals,
              regexp_split_to_array(t, {text(p)}) gaps from d where regexp_matches(t, {text(p)}))"""
        )
    near = lambda a, ks: (
        f"exists (select 1 from s b where b.row = {a}.row and b.kind in {ks} "
        f"and b.start_ < {a}.end_ + {SCOPE} and b.end_ > {a}.start_ - {SCOPE})"
    )
    ident, sec, secret, site, key = (near("w", k) for k in ("(1,3)", "(0,2)", "(0,2,5)", "(4)", "(1)"))
    names = "[" + ",".join(f"'{k}'" for k in KINDS) + "]"
    name = f"{names}[kind + 1] || ':' || start_ || ':' || end_"
    return f"""
    with d as (select row_number() over () row, doc_id, coalesce(text, '') t from documents),
    r as ({" union all ".join(runs)}),
    p as (select row, kind, i, val, length(hit) hit_len,
      sum(length(gaps[i + 1]) + length(hit)) over (partition by row, kind order by i) end_ from r),
    s as (select row, kind, (end_ - hit_len)::bigint start_, end_::bigint end_ from p
      where case kind when 0 then length(val) >= 8 when 5 then regexp_matches(val, '[A-Z]')
        and regexp_matches(val, '[a-z]') and regexp_matches(val, '[0-9]') else true end),
    k as (select * from s where kind < 3 union all select * from s w where
      (kind = 3 and ({sec} or ({secret} and {site}))) or (kind = 4 and ({sec} or {key} or ({secret} and {ident})))
      or (kind = 5 and ({key} or ({ident} and {site})))),
    g as (select row, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access,
      count(*) filter (kind = 2) n_hex,
      coalesce(string_agg({name}, ',' order by start_, kind) filter (kind < 3), '') base,
      string_agg({name}, ',' order by start_, kind) spans from k group by row)
    select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
      sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join g using (row)"""


ORACLE_SQL = _sql()


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_digest(find_secrets(docs))
