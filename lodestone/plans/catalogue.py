"""Queries over the star schema and corpus tables, each the same relational operator as one on archives.

Every query reads whole tables. ``SHARED`` holds text that both engines run; ``PAIRS`` holds (Spark, DuckDB) text where
dialects differ; queries that need more than one statement to scale are functions below.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars
from ..operators import versions
from ..sources.tables import shared_dir
from ..streaming.validation import run_to_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: (child table, child key, parent table, parent key)
EDGES = (
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reference edge: how many references were checked, how many have no target.

    References are counted per key before the join, so that a key with many references costs one row.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def edge(child: str, key: str, parent: str, target: str) -> DataFrame:
        refs = read(child).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
        there = read(parent).select(F.col(target).alias("t")).distinct()
        joined = refs.join(there, F.col("k") == F.col("t"), "left")
        return joined.agg(
            F.lit(f"{child}.{key}").alias("edge"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("checked"),
            F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n")).otherwise(0)), F.lit(0)).cast("long").alias("unresolved"),
        )

    return reduce(DataFrame.unionByName, [edge(*e) for e in EDGES])


def _edges_sql() -> str:
    return " union all ".join(
        f"select '{c}.{k}' as edge, cast(count(*) as bigint) as checked, cast(count(*) filter (where t.{t} is null) as bigint) as unresolved "
        f"from {c} c left join (select distinct {t} from {p}) t on c.{k} = t.{t} where c.{k} is not null"
        for c, k, p, t in EDGES
    )


#: Text that runs in both engines as it stands.
SHARED = {
    # references
    "ref_anti_customer_without_orders": "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)",
    "ref_anti_unlabelled_documents": "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "ref_semi_referenced_parts": "select p_partkey from part p where exists (select 1 from lineitem l where l.l_partkey = p.p_partkey)",
    "ref_precedence_coalesce": "select o_orderkey, coalesce(c.c_mktsegment, o_orderpriority) as resolved from orders o left join customer c on o.o_custkey = c.c_custkey and c.c_acctbal > 0",
    "index_in_range": "select conv_id, turn, turn between 0 and n - 1 as ok from conversations join (select conv_id as cid, count(*) as n from conversations group by conv_id) t on conv_id = cid",
    "opposite_role_pair": "select a.conv_id, a.turn, count(b.turn) as partners from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and b.role <> a.role group by a.conv_id, a.turn",
    "case_fold_ascii_join": "select count(*) as n from nation a join nation b on translate(a.n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(b.n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "null_safe_join": "select sum(a.n) as n from (select nullif(l_returnflag, 'N') as f, count(*) as n from lineitem group by 1) a join (select distinct nullif(l_returnflag, 'N') as f from lineitem) b on a.f is not distinct from b.f",
    # containers and versions
    "superseded_versions": "select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn > 1",
    "latest_wins": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn = 1",
    "first_match_wins": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events) t where rn = 1",
    "illegal_path": "select page_id, case when contains(url, chr(92)) then 'backslash' when substr(url, 1, 1) = '/' then 'absolute' when concat('/', url, '/') like '%/../%' then 'dotdot' else 'ok' end as why from pages",
    "declared_size_mismatch": "select doc_id, n_chars, cast(length(text) as bigint) as actual from documents where n_chars <> length(text)",
    "declared_size_agreement": "select lang, count(*) as n, cast(sum(case when n_chars = length(text) then 1 else 0 end) as bigint) as agree from documents group by lang",
    # projections and scalar functions
    "kind_filter": "select event_id, user_id from events where event_type = 'purchase'",
    "unknown_vocab": "select lang, count(*) as n from documents where lang not in ('en', 'de') group by lang",
    "pointer_escape": "select page_id, replace(replace(url, '~', '~0'), '/', '~1') as ptr from pages",
    "number_parse": "select p_partkey, cast(translate(concat(cast(p_size as varchar(20)), '.5D2'), 'Dd', 'Ee') as double) as v from part",
    "conformer_view": "select event_id from events where event_type is null or event_type in ('click', 'view')",
    "json_opened_objects": "select event_id, cast(length(props) - length(replace(props, chr(123), '')) as bigint) as opened from events",
    # expansions and comparison
    "cross_expand_ops": "select n_nationkey, op, n_nationkey * op + 1 as img from nation cross join (select 1 as op union all select -1 union all select 2) o",
    "asymmetry_self_join": "select a.o as a_c, a.p as b_c, a.n as n_ab, coalesce(b.n, 0) as n_ba, a.n <> coalesce(b.n, 0) as asym from (select l_returnflag as o, l_linestatus as p, count(*) as n from lineitem group by 1, 2) a left join (select l_returnflag as o, l_linestatus as p, count(*) as n from lineitem group by 1, 2) b on a.o = b.p and a.p = b.o",
    "agree_within_tol": "select o_orderkey, abs(o_totalprice - s) > 1e-2 as bad from orders o join (select l_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) as s from lineitem group by l_orderkey) l on o_orderkey = l_orderkey",
    "diff_full_outer": "select coalesce(l.k, r.k) as k, case when l.k is null then 'only on the right' when r.k is null then 'only on the left' when abs(l.v - r.v) > greatest(1e-9 * greatest(abs(l.v), abs(r.v)), 0.0) then 'differ' else 'same' end as st from (select user_id as k, round(sum(value), 6) as v from events where event_type = 'purchase' group by user_id) l full outer join (select user_id as k, round(sum(value), 6) as v from events where event_type = 'signup' group by user_id) r on l.k = r.k",
    # windows
    "ascending_check": "select user_id, cast(sum(case when event_id < prev then 1 else 0 end) as bigint) as violations from (select user_id, event_id, lag(event_id) over (partition by user_id order by ts, event_id) as prev from events) t group by user_id",
    "non_increasing_check": "select l_orderkey, cast(sum(case when l_quantity > prev then 1 else 0 end) as bigint) as violations from (select l_orderkey, l_quantity, lag(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as prev from lineitem) t group by l_orderkey",
    "runs_gaps_islands": "select user_id, event_type, cast(grp as bigint) as grp, count(*) as len from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as grp from events) t group by user_id, event_type, grp",
    "label_counter": "select n_nationkey, concat(cast(n_regionkey as varchar(20)), '-', cast(row_number() over (partition by n_regionkey order by n_nationkey) as varchar(20))) as lbl from nation",
    "segment_start_from_previous_end": "select conv_id, turn, coalesce(lag(turn) over (partition by conv_id order by turn) + 1, 0) as start_turn from conversations",
    # aggregates
    "report_rollup": "select lang, count(*) as n_items, cast(sum(case when n_chars > 5000 then 1 else 0 end) as bigint) as errors, sum(case when n_chars > 5000 then 1 else 0 end) = 0 as ok from documents group by lang",
    "status_rollup": "select user_id, case when sum(case when event_type = 'error' then 1 else 0 end) > 0 then 'failed' when sum(case when event_type = 'purchase' then 1 else 0 end) > 0 then 'converged' else 'pending' end as status from events group by user_id",
    "signed_sum_having": "select l_partkey, cast(sum(case when l_returnflag = 'R' then -1 else 1 end * cast(l_quantity as bigint)) as bigint) as net from lineitem group by l_partkey having sum(case when l_returnflag = 'R' then -1 else 1 end * cast(l_quantity as bigint)) <> 0",
    "parity_rule": "select o_orderkey, n, (n - 1) <= q and (q - (n - 1)) % 2 = 0 as ok from (select l_orderkey, count(*) as n, cast(sum(l_quantity) as bigint) as q from lineitem group by l_orderkey) t join orders on o_orderkey = l_orderkey",
    "weights_sum_to_one": "select user_id, round(sum(value / s), 6) as s, abs(sum(value / s) - 1.0) > 1e-6 as bad from events join (select user_id as u, sum(value) as s from events group by user_id) t on user_id = u group by user_id",
    "first_appearance_groups": "select user_id, event_type, min(event_id) as first_id, count(*) as n from events group by user_id, event_type",
    "distinct_kinds": "select distinct event_type from events",
    "mean_over_grid": "select l_returnflag, round(avg(l_quantity), 6) as mean, count(*) as n from lineitem group by l_returnflag",
    # sets
    "set_difference": "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45",
    "set_intersection": "select p_partkey as k from part intersect select l_partkey from lineitem where l_quantity > 45",
    "set_union": "select s_nationkey as k from supplier union select c_nationkey from customer",
    "bond_pair_canonical": "select distinct least(l_partkey, l_suppkey) as i, greatest(l_partkey, l_suppkey) as j from lineitem",
}

#: name -> (Spark, DuckDB)
PAIRS = {
    "dup_keys": (
        "select sha_h, count(*) as n, min(doc_id) as first_id from (select doc_id, sha2(text, 256) as sha_h from documents) t group by sha_h having count(*) > 1",
        "select sha_h, count(*) as n, min(doc_id) as first_id from (select doc_id, sha256(text) as sha_h from documents) t group by sha_h having count(*) > 1",
    ),
    "size_cap": (
        "select doc_id, cast(octet_length(text) as bigint) as n_bytes from documents where octet_length(text) > 4096",
        "select doc_id, cast(octet_length(encode(text)) as bigint) as n_bytes from documents where octet_length(encode(text)) > 4096",
    ),
    "total_cap_flag": (
        "select source, cast(sum(octet_length(text)) as bigint) as total_bytes, sum(octet_length(text)) > 100000 as blocked from documents group by source",
        "select source, cast(sum(octet_length(encode(text))) as bigint) as total_bytes, sum(octet_length(encode(text))) > 100000 as blocked from documents group by source",
    ),
    "sha256_member": ("select doc_id, sha2(text, 256) as sha_h from documents", "select doc_id, sha256(text) as sha_h from documents"),
    "json_pointer": (
        "select event_id, cast(get_json_object(props, '$.k') as int) as k from events",
        "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
    ),
    "unit_convert": (
        "select p_partkey, round(p_retailprice / 27.211386245988D * 627.5094740631D, 6) as kcal from part",
        "select p_partkey, round(p_retailprice / 27.211386245988 * cast(627.5094740631 as double), 6) as kcal from part",
    ),
    "tensor_long": (
        "select vec_id, pos, cast(v as double) as v from embeddings lateral view posexplode(embedding) t as pos, v",
        "select vec_id, cast(i - 1 as int) as pos, cast(embedding[i] as double) as v from embeddings, range(1, 65) r(i)",
    ),
    "tensor_shape_check": (
        "select vec_id, cast(size(embedding) as bigint) as n, size(embedding) * 4 = 256 as ok from embeddings",
        "select vec_id, cast(len(embedding) as bigint) as n, len(embedding) * 4 = 256 as ok from embeddings",
    ),
    "tensor_norm": (
        "select vec_id, round(sqrt(aggregate(embedding, 0D, (s, x) -> s + cast(x as double) * cast(x as double))), 6) as nrm from embeddings",
        "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as nrm from embeddings",
    ),
    "max_abs": (
        "select vec_id, round(cast(array_max(transform(embedding, x -> abs(x))) as double), 6) as m from embeddings",
        "select vec_id, round(cast(list_max(list_transform(embedding, lambda x: abs(x))) as double), 6) as m from embeddings",
    ),
    "elementwise_disagreement": (
        "select vec_id, cast(size(filter(embedding, x -> abs(x) > 0.25)) as bigint) as n_out from embeddings",
        "select vec_id, cast(len(list_filter(embedding, lambda x: abs(x) > 0.25)) as bigint) as n_out from embeddings",
    ),
    "scrub_redact": (
        "select doc_id, cast(regexp_count(text, '[0-9]+') as int) as matches, regexp_replace(text, '[0-9]+', '[redacted]') as redacted from documents",
        "select doc_id, cast(len(regexp_extract_all(text, '[0-9]+')) as int) as matches, regexp_replace(text, '[0-9]+', '[redacted]', 'g') as redacted from documents",
    ),
    "timestamp_form": (
        "select event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss') as t from events",
        "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as t from events",
    ),
}


def capped_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 differences and their true number: a bounded sort and a combined count, no window over all rows."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang <> 'en'").select("doc_id", "n_chars")
    first = found.orderBy("doc_id").limit(20)
    numbered = first.withColumn("rn", F.row_number().over(Window.orderBy("doc_id")).cast("long"))  # of 20 rows
    return numbered.join(found.agg(F.count("*").alias("total")), how="cross").select("doc_id", "n_chars", "total", "rn")


#: Rows of one block of keys in a running sum.
BLOCK = 4096


def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document starts if all are laid one after the other by id.

    Running sums within blocks of ids, over blocks of blocks, and over those: no task sorts more than about the cube
    root of all rows for a level.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    rows = docs.withColumns({"low": F.floor(F.col("doc_id") / BLOCK), "high": F.floor(F.col("doc_id") / (BLOCK * BLOCK))})
    sums = rows.groupBy("high", "low").agg(F.sum("n_chars").alias("s"))
    before = lambda w: F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy("high").agg(F.sum("s").alias("s")).withColumn("above", before(Window.orderBy("high")))  # a row per 16.8 million ids
    blocks = sums.withColumn("within", before(Window.partitionBy("high").orderBy("low"))).join(tops.select("high", "above"), "high")
    starts = blocks.select("low", (F.col("within") + F.col("above")).alias("start"))
    own = F.sum("n_chars").over(Window.partitionBy("low").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_chars")
    return rows.withColumn("own", own).join(starts, "low").select("doc_id", (F.col("own") + F.col("start")).cast("long").alias("off"))


def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, kept by a stream over the event files: a grouped maximum as its state."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    newest = events.groupBy("user_id").agg(last).select("user_id", "last.event_id", "last.event_type")
    return run_to_table(newest, f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}")


def _latest(read) -> DataFrame:
    return versions.latest(read("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _first(read) -> DataFrame:
    return versions.first(read("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


def _redacted(read) -> DataFrame:
    text, matches = scalars.redact(F.col("text"), "[0-9]+")
    return read("documents").select("doc_id", matches.alias("matches"), text.alias("redacted"))


def _agreeing(read) -> DataFrame:
    lines = read("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("s"))
    rows = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", (~scalars.is_close(F.col("o_totalprice"), F.col("s"), atol=1e-2)).alias("bad"))


#: Queries whose rows come through the library's own operators; their SQL, above, is what they are compared with.
LIBRARY = {
    "latest_wins": _latest,
    "first_match_wins": _first,
    "scrub_redact": _redacted,
    "agree_within_tol": _agreeing,
    "pointer_escape": lambda read: read("pages").select("page_id", scalars.pointer_escape(F.col("url")).alias("ptr")),
    "number_parse": lambda read: read("part").select("p_partkey", scalars.finite_number(F.concat(F.col("p_size").cast("string"), F.lit(".5D2"))).alias("v")),
    "tensor_shape_check": lambda read: read("embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), (scalars.tensor_bytes(F.lit(4), F.array(F.size("embedding"))) == 256).alias("ok")),
}


def _through_library(rows):
    return lambda spark, sf_dir: rows(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))


FUNCTIONS = {
    "stream_latest_status": (stream_latest_status, "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn = 1"),
    "ref_edges": (reference_edges, _edges_sql()),
    "capped_differences": (capped_differences, "select doc_id, n_chars, total, rn from (select doc_id, n_chars, count(*) over () as total, row_number() over (order by doc_id) as rn from documents where lang <> 'en') t where rn <= 20"),
    "running_offset": (running_offset, "select doc_id, cast(sum(n_chars) over (order by doc_id rows between unbounded preceding and current row) - n_chars as bigint) as off from documents"),
}


def _sql(text: str):
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    bound = re.sub(rf"\b(from|join)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(bound, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used if f"{{{t}}}" in bound})

    return run


def queries() -> dict:
    texts = {k: _sql(t) for k, t in SHARED.items()} | {k: _sql(t) for k, (t, _) in PAIRS.items()}
    return {k: f for k, (f, _) in FUNCTIONS.items()} | texts | {k: _through_library(f) for k, f in LIBRARY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: t for k, (_, t) in FUNCTIONS.items()} | dict(SHARED) | {k: t for k, (_, t) in PAIRS.items()}
