"""The registered queries of the sheet engine and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.numfmt import format_column
from .operators import joins, lookup, quality, rows
from .operators.ordering import by, top
from .sources import tables
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def sql(name: str, text: str, tables_: str, oracle: str | None = None) -> None:
    """A query of the SQL surface: text over lazy views, so filters and columns reach the scans."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables_.split())
        return spark.sql(text)

    QUERIES[name] = run
    ORACLE[name] = oracle or text


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers left join orders, cleaned, then totals per segment."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    both = joins.join(c.select("c_custkey", "c_mktsegment"), o.select("o_orderkey", "o_custkey", "o_totalprice"), ("c_custkey", "o_custkey"), "left", keys="sql")
    both = quality.clean(both, quality.Cleaning.of("trim", "upper"), ["c_mktsegment"])
    return both.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES["flagship"] = flagship
ORACLE["flagship"] = "select upper(trim(c_mktsegment)) as c_mktsegment, count(o_orderkey) as n_orders, round(sum(o_totalprice), 2) as total from customer left join orders on c_custkey = o_custkey group by 1"



def sheet(spark: SparkSession, sf_dir: str, name: str, order: str | None = None):
    """A table as a sheet, in the table's own order or sorted."""
    from .sheet import Sheet

    df = load(spark, sf_dir, name)
    return Sheet.of(df.orderBy(order) if order else df, name)


# projections and filters

sql("select_project", "select p_partkey, p_name, p_retailprice from part", "part")
sql("select_exprs", "select p_partkey, p_size * 2 as twice, p_retailprice * 0.9D as sale, concat(p_brand, '/', p_type) as label from part", "part",
    "select p_partkey, p_size * 2 as twice, p_retailprice * 0.9::double as sale, p_brand || '/' || p_type as label from part")


@query("select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def remove_columns(spark, sf_dir):
    return sheet(spark, sf_dir, "customer").remove("c_acctbal").frame


sql("filter_compare", "select p_partkey, p_size from part where p_size >= 10 and p_size < 20 and p_retailprice <> 0", "part")
sql("filter_like", "select p_partkey, p_type from part where p_type like '%E%'", "part")
sql("filter_in", "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'O')", "orders")
sql("filter_is_null", "select o_orderkey from orders where o_orderstatus is not null and not (o_totalprice is null)", "orders")


@query("select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'")
def filter_rows_eq(spark, sf_dir):
    return sheet(spark, sf_dir, "customer").filter_rows("c_mktsegment", "BUILDING").select("c_custkey", "c_mktsegment").frame


@query("select doc_id, lang from documents where coalesce(lang, '') <> '' or coalesce(cast(doc_id as varchar), '') <> ''")
def remove_empty_rows(spark, sf_dir):
    return rows.remove_empty_rows(load(spark, sf_dir, "documents").select("doc_id", "lang"))


@query("select p_partkey, upper(p_name) as p_name, upper(p_brand) as p_brand from part")
def map_upper(spark, sf_dir):
    return sheet(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").map("upper").frame


@query("select n_nationkey, case when n between 2 and 9 then lower(n_name) else n_name end as n_name from (select *, row_number() over (order by n_nationkey) - 1 as n from nation)")
def map_range_lower(spark, sf_dir):
    return sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_name").map("lower", at="B4:B11").frame


# joins


def _table_join(left: tuple[str, ...], right: tuple[str, ...], how: str, keys: str) -> Query:
    def run(spark, sf_dir):
        (lt, *lc), (rt, *rc) = left, right
        return joins.join(load(spark, sf_dir, lt).select(*lc), load(spark, sf_dir, rt).select(*rc), (lc[0], rc[0]), how, keys)

    return run


_CUSTOMER, _ORDERS, _EVENTS = ("customer", "c_custkey", "c_name"), ("orders", "o_custkey", "o_orderkey"), ("events", "user_id", "event_id")
for _how, _left, _right, _sql in (
    ("inner", _CUSTOMER, _ORDERS, "select c_custkey, c_name, o_orderkey from customer join orders on c_custkey = o_custkey"),
    ("left", _CUSTOMER, _EVENTS, "select c_custkey, c_name, event_id from customer left join events on c_custkey = user_id"),
    ("right", _EVENTS, _CUSTOMER, "select c_custkey as user_id, event_id, c_name from events right join customer on c_custkey = user_id"),
    ("full", _CUSTOMER, _EVENTS, "select coalesce(c_custkey, user_id) as c_custkey, c_name, event_id from customer full join events on c_custkey = user_id"),
):
    QUERIES[f"join_{_how}"] = _table_join(_left, _right, _how, "text")
    QUERIES[f"join_{_how}_native"] = _table_join(_left, _right, _how, "sql")
    ORACLE[f"join_{_how}"] = ORACLE[f"join_{_how}_native"] = _sql


@query("""select l.k, l.a, r.b from (values (null, 1), ('', 2), ('30', 3), ('x', 4)) l(k, a)
left join (values (null, 10), ('30', 30), ('y', 40)) r(k, b) on coalesce(l.k, '') = coalesce(r.k, '')""")
def join_null_safe_string_key(spark, sf_dir):
    left = spark.createDataFrame([(None, 1), ("", 2), ("30", 3), ("x", 4)], "k string, a int")
    right = spark.createDataFrame([(None, 10), (30.0, 30), (7.5, 40)], "k double, b int")
    return joins.join(left, right, "k", "left")


sql("join_cross", "select r_name, n_name from region cross join nation", "region nation")


@query("select a.p_partkey, b.p_partkey as other from part a join part b on a.p_size = b.p_size and a.p_retailprice < b.p_retailprice")
def join_theta(spark, sf_dir):
    """The few sizes would be few tasks, and fewer once Spark joined small partitions: the left rows of a size are dealt
    into 8, each of which meets all right rows of the size, and a number given with ``repartition`` stays."""
    n, deals = int(spark.conf.get("spark.sql.shuffle.partitions")), 8
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    a = part.withColumn("deal", F.pmod(F.xxhash64("p_partkey"), F.lit(deals)).cast("int")).repartition(n, "p_size", "deal").alias("a")
    b = part.withColumn("deal", F.explode(F.array(*map(F.lit, range(deals))))).repartition(n, "p_size", "deal").alias("b")
    both = a.join(b, (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.deal") == F.col("b.deal")) & (F.col("a.p_retailprice") < F.col("b.p_retailprice")))
    return both.select("a.p_partkey", F.col("b.p_partkey").alias("other"))


@query("select s_suppkey, s_name, s_nationkey, n_name, n_regionkey, r_name from supplier join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def join_chain(spark, sf_dir):
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return joins.chain(s.select("s_suppkey", "s_name", "s_nationkey"), (n, ("s_nationkey", "n_nationkey"), "inner"), (r, ("n_regionkey", "r_regionkey"), "left"))


@query("select o_orderkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")
def join_semi(spark, sf_dir):
    c = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return joins.semi(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ("o_custkey", "c_custkey")).select("o_orderkey")


@query("select c_custkey from customer where not exists (select 1 from events where user_id = c_custkey)")
def join_anti(spark, sf_dir):
    return joins.anti(load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "events"), ("c_custkey", "user_id"))


@query("select a.r_regionkey, a.r_name, b.n_name, b.n_nationkey from region a join nation b on a.r_regionkey = b.n_nationkey")
def concat_columns(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.col("n_nationkey").alias("__b"))
    return joins.zip_columns(load(spark, sf_dir, "region").withColumn("__a", F.col("r_regionkey")), n, "__a", "__b").drop("__a")


# lookups

TIERS = "(values (0, 'low'), (950, 'mid'), (1200, 'high'), (1500, 'top')) t(floor, tier)"


def _tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0.0, "low"), (1, 950.0, "mid"), (2, 1200.0, "high"), (3, 1500.0, "top")], "pos int, floor double, tier string")


@query("select c_custkey, n_name as nation from customer left join nation on c_nationkey = n_nationkey")
def vlookup_exact(spark, sf_dir):
    n = load(spark, sf_dir, "nation").withColumn("pos", F.col("n_nationkey"))
    return lookup.exact(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", n, "n_nationkey", "n_name", "pos", "nation").drop("c_nationkey")


@query(f"select p_partkey, p_retailprice, (select arg_max(tier, floor) from {TIERS} where floor <= p_retailprice) as tier from part")
def vlookup_approx(spark, sf_dir):
    return lookup.prefix(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", _tiers(spark), "floor", "tier", "pos", "tier")


@query(f"select p_partkey, p_retailprice, (select arg_max(tier, floor) from {TIERS} where floor <= p_retailprice) as tier from part")
def xlookup_next_smaller(spark, sf_dir):
    return lookup.nearest(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", _tiers(spark), "floor", "tier", "tier", "below")


@query(f"select p_partkey, p_retailprice, (select arg_min(tier, floor) from {TIERS} where floor >= p_retailprice) as tier from part")
def xlookup_next_larger(spark, sf_dir):
    return lookup.nearest(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", _tiers(spark), "floor", "tier", "tier", "above")


@query("""select event_id, (select arg_max(o_orderkey, o_orderdate) from (select o_orderdate, min(o_orderkey) as o_orderkey from orders group by 1) where o_orderdate <= ts) as last_order from events""")
def asof_last_order(spark, sf_dir):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double").alias("at")
    o, e = load(spark, sf_dir, "orders").select(micros("o_orderdate"), "o_orderkey"), load(spark, sf_dir, "events").select("event_id", micros("ts"))
    return lookup.nearest(e, "at", o, "at", "o_orderkey", "last_order", "below", row="o_orderkey").select("event_id", "last_order")


@query("select p_partkey, p_name from part where p_name similar to '.*gear' order by p_partkey limit 1")
def xlookup_wildcard(spark, sf_dir):
    return lookup.wildcard(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "*gear", "p_partkey")


@query("select p_partkey, p_name from part where p_name similar to 'red .*' order by p_partkey desc limit 1")
def xlookup_wildcard_last(spark, sf_dir):
    return lookup.wildcard(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "RED *", "p_partkey", ignore_case=True, last=True)


@query("select n_nationkey, (select max(c_custkey) from customer where c_nationkey = n_nationkey) as last_customer from nation")
def xlookup_last_match(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("last_customer"))
    return lookup.exact(load(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", c, "c_nationkey", "last_customer", "pos", "found", last=True).withColumnRenamed("found", "last_customer")


@query("select cast(min(n_nationkey) + 1 as bigint) as position from nation where n_regionkey = 2")
def match_exact(spark, sf_dir):
    return lookup.match_position(load(spark, sf_dir, "nation"), "n_regionkey", 2, "n_nationkey")


@query("select n_name as value from nation where n_nationkey = 6")
def index_cell(spark, sf_dir):
    return lookup.index_cell(load(spark, sf_dir, "nation"), "n_nationkey", 7, "n_name")


# aggregates

_Q1 = """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 6) as avg_price,
min(l_discount) as min_disc, max(l_tax) as max_tax, count(*) as n from lineitem group by l_returnflag, l_linestatus"""
sql("group_sum_avg_min_max_count", _Q1, "lineitem")
sql("group_having", "select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_custkey having count(*) > 12", "orders")
sql("count_distinct", "select count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities from orders", "orders")
sql("select_distinct", "select distinct o_orderstatus, o_orderpriority from orders", "orders")
sql("global_agg", "select count(*) as n, round(sum(l_extendedprice), 2) as total, round(stddev_samp(l_quantity), 6) as sd from lineitem", "lineitem")


@query("select round(sum(n_nationkey + n_regionkey), 6)::double as total, round(avg(n_nationkey), 6) as mean, count(*) * 2 as n, greatest(max(n_nationkey), max(n_regionkey))::double as most, least(min(n_nationkey), min(n_regionkey))::double as least from nation")
def formula_aggregates(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_regionkey")
    row = (s.aggregate("SUM"), round(s.aggregate("AVERAGE", "A2:A26"), 6), s.aggregate("COUNT"), s.aggregate("MAX"), s.aggregate("MIN"))
    return spark.createDataFrame([row], "total double, mean double, n bigint, most double, least double")


@query("select product(r_regionkey + 1) as value from region")
def formula_product(spark, sf_dir):
    s = sheet(spark, sf_dir, "region", "r_regionkey").with_column("one", F.col("r_regionkey") + 1).select("one")
    return spark.createDataFrame([(float(s.evaluate("=PRODUCT(A2:A6)")),)], "value double")


@query("select cast(sum(n_nationkey + n_regionkey) as double) as total from nation where n_nationkey between 2 and 9")
def range_sum_a1(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_regionkey")
    return spark.createDataFrame([(s.aggregate("SUM", "A4:B11"),)], "total double")


@query("select o_orderkey, o_custkey, o_orderpriority from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as n from orders) where n = 1")
def remove_duplicates_first(spark, sf_dir):
    return rows.remove_duplicates(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], "o_orderkey")


# order

sql("order_by_nulls", "select c_custkey, nullif(c_mktsegment, 'BUILDING') as seg from customer order by seg asc nulls last, c_custkey", "customer")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def topk(spark, sf_dir):
    return top(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [by("o_totalprice", True), by("o_orderkey")], 20)


@query("select o_orderkey, o_orderdate from orders order by o_orderkey limit 10 offset 5")
def limit_offset(spark, sf_dir):
    return top(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [by("o_orderkey")], 10, 5)


# set operations and merging

_BOTH = "a as (select s_suppkey as k, s_name as name, s_acctbal as bal from supplier), b as (select c_custkey as k, upper(c_name) as name, c_mktsegment from customer)"


def _both(spark, sf_dir):
    s, c = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer")
    return s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")), c.select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), "c_mktsegment")


@query(f"with {_BOTH} select * from a union all by name select k, name from b")
def append_aligned(spark, sf_dir):
    return rows.append(*_both(spark, sf_dir))


@query("select n_name as name from nation union all select r_name from region")
def append_union_all(spark, sf_dir):
    return rows.append(load(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), load(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query(f"with {_BOTH} select * from a union all by name select k, name from b where k not in (select k from a)")
def append_distinct(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    return rows.append_distinct(a, b, "k", "k")


@query(f"with {_BOTH} select coalesce(a.k, b.k) as k, coalesce(b.name, a.name) as name, a.bal from a full join b on a.k = b.k")
def upsert(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    return rows.upsert(a.withColumn("__t", F.col("k")), b.withColumn("__s", F.col("k")), "k", "__t", "__s").drop("__t")


@query("select 'nation' as source, n_nationkey as k, n_name as name, n_regionkey as region, null as extra from nation union all select 'region', r_regionkey, r_name, null, 'x' from region")
def consolidate_source(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("x").alias("extra"))
    return rows.consolidate({"nation": n, "region": r}, "source")


sql("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier", "customer supplier")
sql("set_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier", "customer supplier")
sql("set_except", "select c_custkey as k from customer except select user_id from events", "customer events")
sql("cte", "with big as (select o_custkey, sum(o_totalprice) as t from orders group by o_custkey) select o_custkey, round(t, 2) as t from big where t > (select avg(t) from big)", "orders")
sql("subquery_from", "select k, count(*) as n from (select o_custkey % 10 as k from orders where o_orderstatus = 'F') s group by k", "orders")
sql("subquery_in_exists", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000) and exists (select 1 from nation where n_nationkey = c_nationkey and n_regionkey < 3)", "customer orders nation")
sql("recursive_cte", "with recursive t(n, f) as (select 1, 1 union all select n + 1, f * (n + 1) from t where n < 10) select n, f from t", "region")

# data quality


@query(r"select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as text, coalesce(lang, '') as lang from documents")
def normalize_whitespace(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.clean(quality.clean(d, quality.Cleaning.of("normalize_whitespace", "lower"), ["text"]), quality.Cleaning.of("null_to_empty"), ["lang"])


@query("select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg from customer")
def fill_nulls(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return quality.clean(c, quality.Cleaning.of("fill_nulls", fill="none"), ["seg"])


@query("select c_custkey from customer where not coalesce(c_acctbal between 0 and 5000, false)")
def validate_range(spark, sf_dir):
    return quality.failures(load(spark, sf_dir, "customer"), "c_acctbal", "range", "c_custkey", low=0, high=5000)


@query("select p_partkey from part where not regexp_matches(p_brand, '^Brand#[1-3]')")
def validate_regex(spark, sf_dir):
    return quality.failures(load(spark, sf_dir, "part"), "p_brand", "regex", "p_partkey", pattern="^Brand#[1-3]")


@query(r"select doc_id, regexp_matches(w, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$') as ok from (select doc_id, regexp_extract(text, '[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*') as w from documents)")
def validate_email(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_extract("text", r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*", 0), F.lit("")).alias("w"))
    return d.select("doc_id", quality.valid(F.col("w"), "email").alias("ok"))


@query(r"select c_custkey, regexp_matches(p, '[0-9]') and regexp_matches(p, '^\+?[0-9().\s-]{7,}$') as ok from (select c_custkey, case when c_custkey % 2 = 0 then '+1 (555) 010-' || c_custkey else 'none' end as p from customer)")
def validate_phone(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+1 (555) 010-"), F.col("c_custkey").cast("string"))).otherwise("none").alias("p"))
    return c.select("c_custkey", quality.valid(F.col("p"), "phone").alias("ok"))


# formula functions: a formula per column, compiled to one expression


def formula(name: str, table: str, key: str, text: str, oracle: str, labels: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, table)
        value = C.formula(text, df.schema)
        # a result that can show an error label is text; where the inputs rule errors out it keeps its type
        return df.select(*key.split(", "), (C.shown(value) if labels else C.strict(value)).alias("value"))

    QUERIES[f"fn_{name}"] = run
    ORACLE[f"fn_{name}"] = f"select {key}, {oracle} as value from {table}"


def _errs(value: str, bad: str, label: str, numeric: bool = True) -> str:
    """Oracle text of a result that shows a label in place of a number (only whole numbers come out as the same text)."""
    return f"case when {bad} then '{label}' else cast(cast({value} as bigint) as varchar) end"


formula("abs", "customer", "c_custkey", "=ABS(c_acctbal)", "abs(c_acctbal)")
formula("round", "lineitem", "l_orderkey, l_linenumber", "=ROUND(l_extendedprice; 0)", "sign(l_extendedprice) * floor(abs(l_extendedprice) + 0.5::double)")
formula("roundup", "lineitem", "l_orderkey, l_linenumber", "=ROUNDUP(l_extendedprice, -2)", "sign(l_extendedprice) * ceil(abs(l_extendedprice) * 0.01::double) / 0.01::double")
formula("rounddown", "lineitem", "l_orderkey, l_linenumber", "=ROUNDDOWN(l_extendedprice, 1)", "sign(l_extendedprice) * floor(abs(l_extendedprice) * 10) / 10")
formula("trunc", "customer", "c_custkey", "=TRUNC(c_acctbal)", "sign(c_acctbal) * floor(abs(c_acctbal))")
formula("int", "customer", "c_custkey", "=INT(c_acctbal)", "floor(c_acctbal)")
formula("sign", "customer", "c_custkey", "=SIGN(c_acctbal)", "cast(sign(c_acctbal) as bigint)")
formula("mod", "part", "p_partkey", "=MOD(p_partkey, p_size - 10)", _errs("p_partkey % nullif(p_size - 10, 0)", "p_size = 10", "#DIV/0!"), labels=True)
formula("power", "part", "p_partkey", "=p_size ^ 2 + POWER(2, 3)", "cast(p_size * p_size + 8 as double)")
formula("sqrt", "part", "p_partkey", "=IF(p_size < 25, SQRT(p_size * p_size), SQRT(p_size))", "case when p_size < 25 then p_size::double else sqrt(p_size) end")
formula("sqrt_error", "part", "p_partkey", "=SQRT((p_size - 10) * ABS(p_size - 10))", _errs("p_size - 10", "p_size < 10", "#NUM!"), labels=True)
formula("ln", "part", "p_partkey", "=ROUND(LN(p_size + 1), 6)", "round(ln(p_size + 1), 6)")
formula("log", "part", "p_partkey", "=ROUND(LOG(p_size + 1, 2), 6)", "round(ln(p_size + 1) / ln(2), 6)")
formula("log10", "part", "p_partkey", "=ROUND(LOG10(p_size + 1), 6)", "round(log10(p_size + 1), 6)")
formula("exp", "nation", "n_nationkey", "=ROUND(EXP(n_nationkey / 10), 6)", "round(exp(n_nationkey / 10.0::double), 6)")
formula("even", "customer", "c_custkey", "=EVEN(c_acctbal)", "sign(c_acctbal) * (ceil(abs(c_acctbal)) + case when ceil(abs(c_acctbal)) % 2 = 1 then 1 else 0 end)")
formula("odd", "customer", "c_custkey", "=ODD(c_acctbal)", "case when c_acctbal < 0 then -1 else 1 end * (ceil(abs(c_acctbal)) + case when ceil(abs(c_acctbal)) % 2 = 0 then 1 else 0 end)")
formula("fact", "nation", "n_nationkey", "=FACT(MOD(n_nationkey, 10))", "cast(factorial(n_nationkey % 10) as double)")
formula("pi", "region", "r_regionkey", "=ROUND(PI() * r_regionkey, 9)", "round(pi() * r_regionkey, 9)")
formula("sum", "lineitem", "l_orderkey, l_linenumber", "=SUM(l_quantity, l_linenumber, l_returnflag)", "l_quantity + l_linenumber")
formula("average", "part", "p_partkey", "=AVERAGE(p_size, p_retailprice)", "(p_size + p_retailprice) / 2")
formula("count", "part", "p_partkey", "=COUNT(p_size, p_name, p_retailprice)", "cast(2 as bigint)")
formula("max_min", "part", "p_partkey", "=MAX(p_size, 20) - MIN(p_size, 20)", "cast(abs(p_size - 20) as double)")
formula("product", "part", "p_partkey", "=PRODUCT(p_size, 2, p_name)", "cast(p_size * 2 as double)")
formula("if", "customer", "c_custkey", '=IF(c_acctbal >= 0, "credit", "debit")', "case when c_acctbal >= 0 then 'credit' else 'debit' end")
formula("and_or_not", "part", "p_partkey", "=AND(OR(p_size < 5, p_size > 45), NOT(p_partkey = 7))", "(p_size < 5 or p_size > 45) and not p_partkey = 7")
formula("isblank", "customer", "c_custkey", "=ISBLANK(c_mktsegment)", "c_mktsegment is null")
formula("iserror", "part", "p_partkey", "=ISERROR(1 / (p_size - 10))", "p_size = 10")
formula("isna", "part", "p_partkey", "=ISNA(#N/A)", "true")
formula("isnumber_istext", "part", "p_partkey", "=AND(ISNUMBER(p_size), ISTEXT(p_name))", "true")
formula("concat", "part", "p_partkey", '=CONCAT(p_brand, "-", p_size, "-", TRUE)', "p_brand || '-' || p_size || '-TRUE'")
formula("ampersand", "part", "p_partkey", '=p_brand & ":" & p_size * 2', "p_brand || ':' || p_size * 2")
formula("len", "part", "p_partkey", "=LEN(p_name)", "length(p_name)")
formula("left", "part", "p_partkey", "=LEFT(p_name, 3)", "left(p_name, 3)")
formula("right", "part", "p_partkey", "=RIGHT(p_name, 4)", "right(p_name, 4)")
formula("trim", "part", "p_partkey", '=TRIM("  " & p_name & " ")', "trim(p_name)")
formula("upper", "part", "p_partkey", "=UPPER(p_name)", "upper(p_name)")
formula("lower", "part", "p_partkey", "=LOWER(p_type)", "lower(p_type)")
formula("proper", "region", "r_regionkey", '=PROPER(r_name & " o\'neil")', "array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') || ' O''Neil'")
formula("date_serial", "nation", "n_nationkey", "=DATE(2024, MOD(n_nationkey, 12) + 1, 15)", "cast(date_diff('day', date '1970-01-01', make_date(2024, (n_nationkey % 12 + 1)::int, 15)) + 25569 as double)")
formula("precedence", "part", "p_partkey", "=-2 ^ 2 + p_size * 50%", "-4 + p_size * 0.5::double")
formula("compare", "part", "p_partkey", "=p_size <> 3", "p_size <> 3")


@query()
def fn_rand(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    both = {"r": "=RAND()", "b": "=RANDBETWEEN(1, 6)", "now": "=NOW() >= TODAY()"}
    return n.select("n_nationkey", *[C.shown(C.formula(t, n.schema)).alias(k) for k, t in both.items()])


# patterns


@query("select l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) as shown from lineitem")
def ssf_thousands(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", format_column("#,##0.00", F.col("l_extendedprice")).alias("shown"))


@query("select l_orderkey, l_linenumber, cast(cast(round(l_discount * 100) as bigint) as varchar) || '%' as shown from lineitem")
def ssf_percent(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", format_column("0%", F.col("l_discount")).alias("shown"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as shown from orders")
def ssf_date(spark, sf_dir):
    serial = F.datediff("o_orderdate", F.lit("1970-01-01")) + 25569
    return load(spark, sf_dir, "orders").select("o_orderkey", format_column("yyyy-mm-dd", serial).alias("shown"))


# nested values


@query("select event_id, json_extract_string(props, '$.k')::bigint as value from events")
def json_extract(spark, sf_dir):
    s = sheet(spark, sf_dir, "events").with_column("value", F.get_json_object("props", "$.k").cast("bigint"))
    return s.select("event_id", "value").frame


@query("select r_regionkey, case when r_regionkey > 2 then 'big' else 'small' end as size from region")
def array_filter_mask(spark, sf_dir):
    return run_script(spark, sf_dir, "region", """
dim big = filter(region.column_by_name("r_regionkey"), [false, false, false, true, true])
dim out = []
for each row in region
  if row.r_regionkey in big then
    out = out + [{r_regionkey: row.r_regionkey, size: "big"}]
  else
    out = out + [{r_regionkey: row.r_regionkey, size: "small"}]
  end if
next
""", region="r_regionkey")


def _rows_of(df: DataFrame, key: str, found: Column) -> DataFrame:
    return tables.exploded(df, key, found).select(key, "table", "row", "is_header", F.concat_ws("|", "cells").alias("cells"))


@query("""select page_id, 0 as "table", 0 as row, true as is_header, 'page|url' as cells from pages
union all select page_id, 0, 1, false, page_id || '|' || coalesce(url, '') from pages""")
def html_first_table(spark, sf_dir):
    # pages are prose without tables: each gets one at its end
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    own = F.concat(F.lit("<table><tr><th>page<th>url</tr><tr><td>"), F.col("page_id").cast("string"), F.lit("<td>"), url, F.lit("</table>"))
    pages = load(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), own).alias("html"))
    return _rows_of(pages, "page_id", tables.html_tables_of(F.col("html")))


@query("""select c_custkey, 0 as "table", 0 as row, true as is_header, 'key|name' as cells from customer
union all select c_custkey, 0, 1, false, c_custkey || '|' || c_name from customer""")
def markdown_tables(spark, sf_dir):
    made = F.concat(F.lit("| key | name |\n|---|---|\n| "), F.col("c_custkey").cast("string"), F.lit(" | "), F.col("c_name"), F.lit(" |\n"))
    return _rows_of(load(spark, sf_dir, "customer").select("c_custkey", made.alias("md")), "c_custkey", tables.markdown_tables_of(F.col("md")))


# windows and grouping sets

sql("window_rank", "select o_orderkey, o_custkey, cast(rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as place from orders", "orders")


@query("select o_orderkey, o_custkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as running from orders")
def window_running_sum(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


sql("cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)", "lineitem")
sql("rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup(l_returnflag, l_linestatus)", "lineitem")
sql("grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())", "orders")

# streams, over a table


@query("select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2, 3")
def tumbling_events(spark, sf_dir):
    aggs: list[Column] = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")]
    out = windows.tumbling(load(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], aggs)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""with g as (select *, case when ts < lag(ts) over w + interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g)
select min(ts) as session_start, max(ts) + interval 30 minutes as session_end, user_id, count(*) as n from s group by user_id, s""")
def session_events(spark, sf_dir):
    out = windows.sessions(load(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


# sheets and scripts


@query("select 'r_name' as col, max(case when r_regionkey = 0 then r_name end) as column_0, max(case when r_regionkey = 1 then r_name end) as column_1, max(case when r_regionkey = 2 then r_name end) as column_2 from region")
def transpose_small(spark, sf_dir):
    from .sheet import Sheet

    s = Sheet.of(load(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").limit(3))
    return s.transpose().frame.select(F.lit("r_name").alias("col"), "*")


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice, case when l_quantity * l_extendedprice >= 50000 then 1 else 0 end + l_quantity as total from lineitem")
def fill_down_lifted(spark, sf_dir):
    from .plans.grid import lift

    out = lift(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "total", "=IF(C1*D1>=50000, 1, 0)+C1")
    return out.withColumn("total", F.col("total").cast("double"))




def run_script(spark: SparkSession, sf_dir: str, names: str, text: str, out: str = "out", **order: str) -> DataFrame:
    """``out`` of a script that sees the tables ``names``; FOLDER in its text is a fresh shared folder."""
    from .lang.interpreter import Interpreter
    from .sources.shared import fresh_path

    run = Interpreter(spark)
    for n in names.split():
        run.set(n, sheet(spark, sf_dir, n, order.get(n)))
    run.run(text.replace("FOLDER", fresh_path(spark, "files")))
    return run.frame(out)


SCRIPT = """
dim big = query(select l_returnflag, sum(l_quantity) as qty, avg(l_discount) as disc from lineitem where l_quantity > 10 group by l_returnflag)
function label(flag, optional suffix = "!")
  if flag = "A" then
    return "returned" & suffix
  else
    return flag & suffix
  end if
end function
dim out = []
for each row in big
  out = out + [{flag: label(row.l_returnflag), qty: round(row.qty, 2)}]
next
"""


@query("select case when l_returnflag = 'A' then 'returned!' else l_returnflag || '!' end as flag, round(sum(l_quantity), 2) as qty from lineitem where l_quantity > 10 group by 1")
def dsl_script_q1(spark, sf_dir):
    from .lang.interpreter import Interpreter

    run = Interpreter(spark)
    run.set("lineitem", load(spark, sf_dir, "lineitem"))
    run.run(SCRIPT)
    return run.frame("out").select("flag", "qty")


@query("select r_regionkey, r_name, upper(r_name) || '-' || (r_regionkey * 2) as tag from region")
def dsl_lambda_map(spark, sf_dir):
    from .lang.interpreter import Interpreter

    run = Interpreter(spark)
    run.set("region", load(spark, sf_dir, "region"))
    run.run('dim r = region.filter(x => x.r_regionkey >= 0)\ndim out = with_column(r, "tag", x => upper(x.r_name) & "-" & (x.r_regionkey * 2))')
    return run.frame("out").select("r_regionkey", "r_name", "tag")


@query("select r_regionkey, r_regionkey * 2 + 1 as twice from region")
def dsl_python_udf(spark, sf_dir):
    from .lang.interpreter import Interpreter

    run = Interpreter(spark)
    run.register_python("twice", "lambda x: x * 2 + 1", "int")
    load(spark, sf_dir, "region").createOrReplaceTempView("region")
    run.run("dim out = query(select r_regionkey, twice(r_regionkey) as twice from region)")
    return run.frame("out")


from . import catalog_sheets  # noqa: E402, F401  registers its queries
