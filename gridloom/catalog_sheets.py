"""Registered queries of sheets, books, files, scripts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import load, query, run_script, sheet
from .operators import lookup
from .operators.ordering import ROW
from .sheet import Book, Sheet
from .sources import files
from .sources.shared import fresh_path
from .streaming import windows

# row numbers after verbs that shuffle


def numbered(s: Sheet) -> DataFrame:
    return s.df.withColumnRenamed(ROW, "at")


@query("select c_custkey, c_mktsegment, event_id, row_number() over (order by c_custkey, event_id nulls last) - 1 as at from customer left join events on c_custkey = user_id")
def sheet_join_left(spark, sf_dir):
    c = sheet(spark, sf_dir, "customer", "c_custkey").select("c_custkey", "c_mktsegment")
    return numbered(c.join(sheet(spark, sf_dir, "events", "event_id").select("user_id", "event_id"), ("c_custkey", "user_id"), "left"))


@query("select l_orderkey, l_linenumber, l_quantity, row_number() over (order by l_orderkey, l_linenumber, l_quantity) - 1 as at from lineitem where l_quantity > 25")
def sheet_where_numbered(spark, sf_dir):
    s = Sheet.of(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").orderBy("l_orderkey", "l_linenumber", "l_quantity"))
    return numbered(s.where("l_quantity > 25"))


@query("""select coalesce(s_suppkey, c_custkey) as k, coalesce(c_name, s_name) as name, row_number() over (order by s_suppkey is null, coalesce(s_suppkey, c_custkey)) - 1 as at
from supplier full join customer on s_suppkey = c_custkey""")
def sheet_upsert(spark, sf_dir):
    s, c = sheet(spark, sf_dir, "supplier", "s_suppkey"), sheet(spark, sf_dir, "customer", "c_custkey")
    return numbered(s.select("s_suppkey", "s_name").rename("s_suppkey", "k").rename("s_name", "name").upsert(c.select("c_custkey", "c_name").rename("c_custkey", "k").rename("c_name", "name"), "k"))


@query("""with u as (select 0 as side, p_partkey as k, p_brand as b from part union all select 1, s_suppkey, s_name from supplier),
j as (select side, k, b, o_orderkey from u left join orders on k = o_custkey), d as (select *, row_number() over (partition by k order by side, o_orderkey nulls last) as n from j)
select k, b, o_orderkey, row_number() over (order by side, k) - 1 as at from d where n = 1""")
def sheet_chain(spark, sf_dir):
    p = sheet(spark, sf_dir, "part", "p_partkey").select("p_partkey", "p_brand").rename("p_partkey", "k").rename("p_brand", "b")
    s = sheet(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", "s_name").rename("s_suppkey", "k").rename("s_name", "b")
    o = sheet(spark, sf_dir, "orders", "o_orderkey").select("o_custkey", "o_orderkey")
    return numbered(p.append(s).join(o, ("k", "o_custkey"), "left").remove_duplicates("k"))


@query("select c_custkey, c_acctbal, row_number() over (order by c_acctbal desc nulls first, c_custkey) - 1 as at from customer")
def sheet_sort(spark, sf_dir):
    return numbered(sheet(spark, sf_dir, "customer", "c_custkey").select("c_custkey", "c_acctbal").sort("c_acctbal", descending=True))


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as at from (select * from orders order by o_totalprice desc, o_orderkey limit 15)")
def sheet_top(spark, sf_dir):
    return numbered(sheet(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", "o_totalprice").top(15, "o_totalprice"))


@query("select n_nationkey, n_name, row_number() over (order by n_nationkey) - 1 as at from (select * from nation order by n_nationkey limit 7 offset 3)")
def sheet_take(spark, sf_dir):
    return numbered(sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_name").take(7, 3))


@query("select k, name, row_number() over (order by side, k) - 1 as at from (select 0 as side, s_suppkey as k, s_name as name from supplier union all select 1, c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier))")
def sheet_append_distinct(spark, sf_dir):
    s, c = sheet(spark, sf_dir, "supplier", "s_suppkey"), sheet(spark, sf_dir, "customer", "c_custkey")
    return numbered(s.select("s_suppkey", "s_name").rename("s_suppkey", "k").rename("s_name", "name").append_distinct(c.select("c_custkey", "c_name").rename("c_custkey", "k").rename("c_name", "name"), "k"))


@query("select doc_id, lang, row_number() over (order by doc_id) - 1 as at from documents where coalesce(lang, '') <> '' or doc_id is not null")
def sheet_remove_empty_rows(spark, sf_dir):
    return numbered(sheet(spark, sf_dir, "documents", "doc_id").select("doc_id", "lang").remove_empty_rows())


# addresses and edits


@query("select n_name, n_regionkey from (select *, row_number() over (order by n_nationkey) - 1 as n from nation) where n between 3 and 6")
def sheet_a1_range(spark, sf_dir):
    return sheet(spark, sf_dir, "nation", "n_nationkey").a1("B5:C8").frame


@query("select 'B1' as at, 'n_name' as value union all select 'B4', n_name from nation where n_nationkey = 2 union all select 'R5C1', '3' union all select 'last', (select arg_max(n_name, n_nationkey) from nation) union all select 'first', (select arg_min(n_name, n_nationkey) from nation)")
def sheet_cells(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation", "n_nationkey")
    return spark.createDataFrame([("B1", s.a1("B1")), ("B4", s.a1("B4")), ("R5C1", str(s.a1("R5C1"))), ("last", s.row(-1)["n_name"]), ("first", s.cell(0, "n_name"))], "at string, value string")


@query("select r_regionkey, case r_regionkey when 1 then 'changed' when 3 then 'too' when 4 then 'by name' else r_name end as r_name from region")
def sheet_set_cells(spark, sf_dir):
    s = sheet(spark, sf_dir, "region", "r_regionkey").select("r_regionkey", "r_name")
    return s.set("B3", "changed").set_at(3, "r_name", "too").set_row_named("r_regionkey", 4, r_name="by name").frame


@query("select n - 1 as at, name from (select row_number() over (order by k) as n, name from (select r_regionkey * 10 as k, case r_regionkey when 2 then 'new' else r_name end as name from region union all select 15, 'between' union all select 99, 'end'))")
def sheet_row_edits(spark, sf_dir):
    s = sheet(spark, sf_dir, "region", "r_regionkey").select("r_name").rename("r_name", "name")
    return numbered(s.update_row(2, "new").insert_row(2, "between").append_row("end"))


@query("select r_regionkey, r_regionkey * 2 as twice, r_name, 'v' || r_regionkey as v from region")
def sheet_column_edits(spark, sf_dir):
    s = sheet(spark, sf_dir, "region", "r_regionkey").select("r_regionkey", "r_name")
    return s.insert_column(1, "twice", F.col("r_regionkey") * 2).with_values("v", [f"v{i}" for i in range(5)]).frame


@query("select n_nationkey, n_regionkey from nation")
def sheet_filter_columns(spark, sf_dir):
    return sheet(spark, sf_dir, "nation").filter_columns(lambda j, name: name.endswith("key")).frame


@query("select n_nationkey, n_name from nation where n_nationkey not in (0, 3, 7)")
def sheet_remove_rows(spark, sf_dir):
    return sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_name").remove_rows(0, 3, 7).frame


@query("select n_nationkey::varchar as \"0\", n_name as \"NATION_0\" from nation where n_nationkey > 0")
def sheet_name_columns_by_row(spark, sf_dir):
    return sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_name").name_columns_by_row(0).frame


@query("select r_regionkey, r_name, r_regionkey as r_regionkey_1, r_name as r_name_1 from region")
def sheet_zip(spark, sf_dir):
    s = sheet(spark, sf_dir, "region", "r_regionkey").select("r_regionkey", "r_name")
    return s.zip(s).frame


@query("select n_nationkey, case when n_nationkey between 1 and 4 then lower(n_name) else n_name end as n_name from nation")
def sheet_clean_range(spark, sf_dir):
    return sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_name").clean("lower", at="B3:B6").frame


@query("select n_nationkey + 2 as at from nation where n_nationkey not between 5 and 20")
def sheet_invalid_rows(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation", "n_nationkey")
    return spark.createDataFrame([(int(i) + 1,) for i in s.invalid("n_nationkey", "range", low=5, high=20)], "at bigint")


@query("select n_nationkey, n_regionkey, cast(n_nationkey * 2 + n_regionkey as double) as v, n_nationkey > 10 as big from nation")
def sheet_formulas(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_regionkey").fill_down("v", "=A2*2+B2").with_formula("big", "=n_nationkey > 10")  # a cell that may show an error is text
    return s.with_column("v", F.col("v").cast("double")).with_column("big", F.col("big") == "TRUE").frame


@query("select 'a' as k, 6.0::double as v union all select 'b', 12.0::double union all select 'c', 18.0::double union all select 'd', 1.0::double")
def sheet_recalculated(spark, sf_dir):
    rows = [["k", "v"], ["a", "=SUM(1, 2, 3)"], ["b", "=B2*2"], ["c", "=SUM(B2:B3)"], ["d", "=IF(B4>17, 1, 0)"]]
    return Sheet.from_data(spark, rows, headers=True).recalculated().with_column("v", F.col("v").cast("double")).frame


# books


@query("select 'nation' as sheet, n_nationkey as k, n_name as name from nation union all select 'region', r_regionkey, r_name from region union all select 'region_1', r_regionkey, r_name from region")
def book_merge_consolidate(spark, sf_dir):
    n = sheet(spark, sf_dir, "nation").select("n_nationkey", "n_name").rename("n_nationkey", "k").rename("n_name", "name")
    r = sheet(spark, sf_dir, "region").select("r_regionkey", "r_name").rename("r_regionkey", "k").rename("r_name", "name")
    return Book({"nation": n, "region": r}).merge(Book({"region": r})).consolidate("sheet").frame


@query("select 'nation' as sheet, n_nationkey::double as k, n_name as name from nation union all select 'region', r_regionkey, r_name from region")
def book_xlsx(spark, sf_dir):
    path = fresh_path(spark, "book") + ".xlsx"
    n = sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_name").rename("n_nationkey", "k").rename("n_name", "name")
    r = sheet(spark, sf_dir, "region", "r_regionkey").select("r_regionkey", "r_name").rename("r_regionkey", "k").rename("r_name", "name")
    Book({"nation": n, "region": r}).write(path)
    return Book.read(spark, path).consolidate("sheet").with_column("k", F.col("k").cast("double")).frame


@query("select 'nation' as source, n_nationkey::bigint as k, n_name as name from nation union all select 'region', r_regionkey, r_name from region")
def book_csv_folder(spark, sf_dir):
    folder = fresh_path(spark, "csvs")
    for t, k, name in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        files.put_bytes(spark, f"{folder}/{t}.csv", "\n".join(["k,name", *[f"{r[0]},{r[1]}" for r in sheet(spark, sf_dir, t, k).select(k, name).rows()]]).encode())
    return Book.read_dir(spark, folder).consolidate("source").frame


# files: written, then read


def through(s: Sheet, kind: str) -> Sheet:
    path = f"{fresh_path(s.body.sparkSession, 'file')}.{kind}"
    s.write(path)
    return Sheet.read(s.body.sparkSession, path)


_FILE = "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation"


def _of_kind(kind: str):
    def run(spark, sf_dir):
        s = through(sheet(spark, sf_dir, "nation", "n_nationkey"), kind)
        return s.frame.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))

    run.__name__ = f"file_{kind}"
    return run


for _kind in ("csv", "tsv", "json", "jsonl", "parquet", "xlsx", "toon"):
    query(_FILE)(_of_kind(_kind))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def file_csv_orders(spark, sf_dir):
    return through(sheet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "csv").frame


@query("select doc_id, text from documents where text is not null and text <> ''")
def file_jsonl_documents(spark, sf_dir):
    return through(sheet(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", "text"), "jsonl").select("doc_id", "text").frame


@query("select event_id, user_id, event_type from events")
def file_json_events(spark, sf_dir):
    return through(sheet(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "json").frame


@query("select 'k' as column_0, 'name' as column_1 union all select r_regionkey::varchar, r_name from region")
def file_csv_without_headers(spark, sf_dir):
    path = fresh_path(spark, "file") + ".csv"
    sheet(spark, sf_dir, "region").select("r_regionkey", "r_name").rename("r_regionkey", "k").rename("r_name", "name").write(path)
    return Sheet.read(spark, path, has_headers=False).frame


def _exported(spark, sf_dir, kind: str, mode: str) -> DataFrame:
    """Suppliers, then customers written to one file by key k."""
    path = f"{fresh_path(spark, 'export')}.{kind}"
    for t, k, name in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")):
        s = sheet(spark, sf_dir, t, k).select(k, name).rename(k, "k").rename(name, "name")
        s.write(path, "overwrite" if t == "supplier" else mode, "k")
    return Sheet.read(spark, path).select("k", "name").frame


_KEYS = "with a as (select s_suppkey as k, s_name as name from supplier), b as (select c_custkey as k, c_name as name from customer) "


@query(_KEYS + "select * from a union all select * from b")
def export_append_csv(spark, sf_dir):
    return _exported(spark, sf_dir, "csv", "append")


@query(_KEYS + "select * from a union all select * from b")
def export_append_jsonl(spark, sf_dir):
    return _exported(spark, sf_dir, "jsonl", "append")


@query(_KEYS + "select * from a union all select * from b where k not in (select k from a)")
def export_append_distinct(spark, sf_dir):
    return _exported(spark, sf_dir, "csv", "append_distinct")


@query(_KEYS + "select k, coalesce(b.name, a.name) as name from a full join b using (k)")
def export_append_or_update(spark, sf_dir):
    return _exported(spark, sf_dir, "parquet", "append_or_update")


@query("select r_regionkey::bigint as k, r_name as name from region")
def file_html(spark, sf_dir):
    path = fresh_path(spark, "page") + ".html"
    cells = "".join(f"<tr><td>{r[0]}</td><td>{r[1]}</td></tr>" for r in sheet(spark, sf_dir, "region").rows())
    files.put_bytes(spark, path, f"<p>x</p><table><tr><th>k</th><th>name</th></tr>{cells}</table>".encode())
    return Sheet.read(spark, path).frame.select(F.col("k").cast("bigint").alias("k"), "name")


@query("select r_regionkey::bigint as k, r_name as name from region")
def file_markdown(spark, sf_dir):
    path = fresh_path(spark, "page") + ".md"
    files.put_bytes(spark, path, ("text\n\n| k | name |\n|---|---|\n" + "".join(f"| {r[0]} | {r[1]} |\n" for r in sheet(spark, sf_dir, "region").rows())).encode())
    return Book.read(spark, path).get(0).frame.select(F.col("k").cast("bigint").alias("k"), "name")


# scripts


@query("""select len, length, kind, keys, total, mean, least, most, whole, real, shown, part, picked from (select 1 as len, 2 as length, 'array' as kind, 'a,b' as keys, (select sum(r_regionkey) from region)::double as total,
(select avg(r_regionkey) from region) as mean, (select min(r_regionkey) from region)::double as least, (select max(r_regionkey) from region)::double as most, 12 as whole, 2.5::double as real, '7' as shown, 'el' as part, 3 as picked)""")
def dsl_builtins(spark, sf_dir):
    return run_script(spark, sf_dir, "region", """
dim ks = region.column_by_name("r_regionkey")
dim o = {a: 1, b: 2}
dim names = keys(o)
dim kept = filter([1, 2, 3], [false, false, true])
dim out = [{len: len("é"), length: length("é"), kind: type(ks), keys: names[0] & "," & names[1], total: sum(ks), mean: avg(ks), least: min(ks), most: max(ks),
  whole: int("12"), real: float("2.5"), shown: str(7), part: substr("hello", 1, 2), picked: kept[0]}]
""".replace(",\n  ", ", ")).selectExpr("len", "length", "kind", "keys", "total", "mean", "least", "most", "whole", "real", "shown", "part", "picked")


@query("""select n_nationkey, case when n_regionkey = 1 then 'one' when n_regionkey = 2 then 'two' else 'other' end as region, least(n_nationkey, 9) as low from nation""")
def dsl_control_flow(spark, sf_dir):
    return run_script(spark, sf_dir, "nation", """
function low(n, optional most = 9)
  dim r = n
  while r > most
    r = r - 1
  wend
  return r
end function
dim out = []
for each row in nation
  dim region = "other"
  if row.n_regionkey = 1 then
    region = "one"
  elseif row.n_regionkey = 2 then
    region = "two"
  end if
  out = out + [{n_nationkey: row.n_nationkey, region: region, low: low(row.n_nationkey)}]
next
""", nation="n_nationkey")


@query("select c_custkey, upper(c_name) as c_name, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 and c_name like '%1'")
def dsl_sheet_verbs(spark, sf_dir):
    return run_script(spark, sf_dir, "customer nation", """
dim some = customer.filter(r => r.c_acctbal > 0 and r.c_name like "%1")
dim some2 = some.select_columns(["c_custkey", "c_name", "c_nationkey"])
dim up = sheet_map(some2, "upper")
dim j = up join nation on "c_nationkey" = "n_nationkey"
dim out = j.select_columns(["c_custkey", "c_name", "n_name"])
""")


@query("select k, name from (select s_suppkey as k, s_name as name from supplier union all select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)) union all select -1, 'added'")
def dsl_files_and_merging(spark, sf_dir):
    return run_script(spark, sf_dir, "supplier customer", """
dim s = query(select s_suppkey as k, s_name as name from supplier)
dim c = query(select c_custkey as k, c_name as name from customer)
export s to "FOLDER/s.csv"
export c to "FOLDER/c.jsonl"
import "FOLDER/s.csv" into s2
import "FOLDER/c.jsonl" into c2
dim both = s2 append distinct c2 on "k"
dim out = both + [{k: -1, name: "added"}]
""")


@query("select 'nation' as src, n_nationkey as k from nation union all select 'region', r_regionkey from region")
def dsl_books(spark, sf_dir):
    return run_script(spark, sf_dir, "nation region", """
dim n = query(select n_nationkey as k from nation)
dim r = query(select r_regionkey as k from region)
dim b = book_from_dict({nation: n, region: r})
dim out = b.consolidate("src")
""")


@query("select r_regionkey, case r_regionkey when 1 then 'set' when 2 then 'named' else r_name end as r_name from region order by r_regionkey desc limit 4")
def dsl_sheet_edits(spark, sf_dir):
    return run_script(spark, sf_dir, "region", """
dim a = region.select_columns(["r_regionkey", "r_name"])
dim b = a.set_a1("B3", "set")
dim c = b.set_row_by_name("r_regionkey", 2, {r_name: "named"})
dim d = c.sort("r_regionkey", true)
dim out = d.take(4)
""", region="r_regionkey")


# lookups


@query("select n_nationkey, case when n_regionkey = 4 then '#N/A' else ['zero', 'one', 'two', 'three'][n_regionkey + 1] end as v, case when n_nationkey >= 20 then 'high' when n_nationkey >= 10 then 'mid' else 'low' end as tier, "
       "case when n_nationkey >= 20 then 'C' when n_nationkey >= 10 then 'B' else 'A' end as grade, case when n_nationkey < 24 then (n_nationkey // 6 + 1) else 4 end as place from nation")
def formula_lookups(spark, sf_dir):
    """A lookup column over fixed ranges of the sheet's own cells and over another sheet's, filled down."""
    s = sheet(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", "n_regionkey")
    t = Sheet.from_data(spark, [["k", "v", "floor", "tier", "grade", "step"], [0, "zero", 0, "low", "A", 0], [1, "one", 10, "mid", "B", 6], [2, "two", 20, "high", "C", 12], [3, "three", 99, "none", "D", 18]], headers=True)
    s = s.fill_down("v", "=VLOOKUP(B2, t!$A$2:$B$5, 2, FALSE)", others={"t": t})
    s = s.fill_down("tier", "=VLOOKUP(A2, t!$C$2:$D$5, 2)", others={"t": t})
    s = s.fill_down("grade", "=XLOOKUP(A2, t!$C$2:$C$5, t!$E$2:$E$5, \"none\", -1)", others={"t": t})
    s = s.fill_down("place", "=MATCH(A2, t!$F$2:$F$5, 1)", others={"t": t})
    return s.select("n_nationkey", "v", "tier", "grade", "place").with_column("place", F.col("place").cast("bigint")).frame


@query("select 'hlookup' as f, '20' as v union all select 'hlookup approx', 'b' union all select 'match down', '2' union all select 'match exact', '3' union all select 'xlookup last', 'z' union all select 'xlookup larger', 'y' "
       "union all select 'index', '4' union all select 'offset', '3'")
def script_lookups(spark, sf_dir):
    return run_script(spark, sf_dir, "region", """
dim m = [[1, 5, 9], ["a", "b", "c"], [10, 20, 30]]
dim out = [{f: "hlookup", v: str(hlookup(5, m, 3, false))}, {f: "hlookup approx", v: hlookup(7, m, 2)}, {f: "match down", v: str(match(6, [9, 7, 3], -1))}, {f: "match exact", v: str(match("c", ["a", "b", "c"], 0))}, {f: "xlookup last", v: xlookup(1, [1, 2, 1], ["x", "y", "z"], "none", 0, -1)}, {f: "xlookup larger", v: xlookup(2, [1, 3, 5], ["x", "y", "z"], "none", 1)}, {f: "index", v: str(index([[1, 2], [3, 4]], 2, 2))}, {f: "offset", v: str(offset([[1, 2], [3, 4]], 1, 0, 1, 1))}]
""")


@query("""select p_partkey, (select arg_max(k, pos) from (select p_size as k, p_partkey as pos, max(p_size) over (order by p_partkey) as top from part) where top <= p_size) as hit from part""")
def vlookup_unsorted(spark, sf_dir):
    t = load(spark, sf_dir, "part").select(F.col("p_size").alias("k"), F.col("p_size").alias("v"), F.col("p_partkey").alias("pos"))
    return lookup.prefix(load(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", t, "k", "v", "pos", "hit").select("p_partkey", "hit")


# windows over time


@query("""select w as window_start, w + interval 2 hours as window_end, event_type, count(*) as n from (select *, unnest([date_trunc('hour', ts) - interval 1 hour, date_trunc('hour', ts)]) as w from events) group by w, event_type""")
def sliding_events(spark, sf_dir):
    out = windows.tumbling(load(spark, sf_dir, "events"), "ts", "2 hours", ["event_type"], [F.count(F.lit(1)).alias("n")], slide="1 hour")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end, event_type, count(*) as n from events group by 1, 2, 3")
def stream_days(spark, sf_dir):
    """The same windows by a stream over the folder, with a watermark; the last update of a window is its result."""
    out, at = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-in")
    load(spark, sf_dir, "events").repartitionByRange(4, "ts").write.parquet(at)
    stream = spark.readStream.schema(load(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(at)
    days = windows.tumbling(stream, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")], late="40 days")

    def put(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    days.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", fresh_path(spark, "stream-state")).foreachBatch(put).start().awaitTermination()
    w = Window.partitionBy("window_start", "event_type").orderBy(F.desc("batch"))
    last = spark.read.parquet(out).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")
    return last.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


# the SQL engine, charts, helpers


@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_custkey")
def engine_registered_file(spark, sf_dir):
    from .plans.engine import SqlEngine

    path = fresh_path(spark, "engine") + ".csv"
    sheet(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").write(path)
    e = SqlEngine(spark)
    name = e.register_csv(path, "orders_file")
    return e.query(f"select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from {name} group by o_custkey")


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey where r_regionkey < 2")
def sql_over_files(spark, sf_dir):
    return run_script(spark, sf_dir, "nation region", """
export nation to "FOLDER/n.jsonl"
export region to "FOLDER/r.csv"
dim out = query(select n_name, r_name from "FOLDER/n.jsonl" as n join "FOLDER/r.csv" as r on n_regionkey = r_regionkey where r_regionkey < 2)
""")


@query("select c_mktsegment as name, count(*) as value from customer group by 1")
def chart_points(spark, sf_dir):
    from . import charts

    c = charts.spec(load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "bar", "c_mktsegment", "n")
    return spark.createDataFrame(list(zip(c["x"]["values"], c["series"][0]["values"], strict=True)), "name string, value bigint")


@query("select c_custkey, c_name as entered, case when c_custkey < 100 then c_mktsegment end as formatted from customer")
def cell_data_fields(spark, sf_dir):
    from .functions.celldata import field

    c = load(spark, sf_dir, "customer")
    cell = F.when(F.col("c_custkey") < 100, F.to_json(F.struct(F.col("c_name").alias("ue"), F.col("c_mktsegment").alias("formattedValue")))).otherwise(F.to_json(F.struct(F.col("c_name").alias("userEnteredValue"))))
    return c.select("c_custkey", field(cell, "user_entered_value").alias("entered"), field(cell, "formatted_value").alias("formatted"))


@query("select n_nationkey, chr(65 + n_nationkey) || (n_nationkey + 1) as a1, '$' || chr(65 + n_nationkey) || '$' || (n_nationkey + 1) as fixed, '=SUM(' || chr(66 + n_nationkey) || (n_nationkey + 3) || ', $A$1)' as moved from nation")
def address_helpers(spark, sf_dir):
    from .plans import formulas as P
    from .plans.addresses import Cell, parse_cell

    out = []
    for k in load(spark, sf_dir, "nation").select("n_nationkey").toPandas().n_nationkey.tolist():
        c = Cell(k, k)
        tree = P.shifted(P.parse(f"=SUM({c.text()}, $A$1)"), 2, 1)
        out.append((k, parse_cell(f"R{k + 1}C{k + 1}").text().replace("$", ""), Cell(k, k, True, True).text(), "=" + P.written(tree)))
    return spark.createDataFrame(out, "n_nationkey int, a1 string, fixed string, moved string")


@query("""select c_custkey, case when c_acctbal < 0 then '(' || format('{:,.2f}', -c_acctbal) || ')' when c_acctbal = 0 then 'none' else format('{:,.2f}', c_acctbal) end as shown,
case when c_acctbal < 0 then 'Red' end as color from customer""")
def ssf_sections(spark, sf_dir):
    from .functions.numfmt import color, format_column

    pattern = '#,##0.00;[Red](#,##0.00);"none"'
    named = F.when(F.col("c_acctbal") < 0, F.lit(color(pattern, -1))).otherwise(F.lit(color(pattern, 1)))
    return load(spark, sf_dir, "customer").select("c_custkey", format_column(pattern, F.col("c_acctbal")).alias("shown"), named.alias("color"))


@query("select 1 as k, 'line 2: division by zero' as v union all select 2, '172800000' union all select 3, '9' union all select 4, '5' union all select 5, '6' union all select 6, '3'")
def dsl_errors_and_assignment(spark, sf_dir):
    from .errors import GridError
    from .lang.interpreter import Interpreter

    def value(text: str) -> str:
        run = Interpreter(spark)
        try:
            run.run(text)
        except GridError as e:
            return str(e)
        return str(run.get("r"))

    texts = ["dim x = 1\ndim r = x / 0", "dim r = interval 2 days", "dim a = [1, 2]\na[1] = 9\ndim r = a[1]", "dim o = {a: {b: 1}}\no.a.b = 5\ndim r = o.a.b", "function f(byref a, paramarray c)\n a = a + length(c)\nend function\ndim r = 3\nf(r, 1, 2, 3)", "dim n = 2\ndim f = x => x + 1\ndim r = f(n)"]
    return spark.createDataFrame([(k, value(t)) for k, t in enumerate(texts, 1)], "k int, v string")


@query("select r_regionkey::bigint as r_regionkey, r_name from region")
def sheet_conversions(spark, sf_dir):
    """Through pandas, records and JSON text and back."""
    import json

    s = sheet(spark, sf_dir, "region", "r_regionkey").select("r_regionkey", "r_name")
    back = Sheet.from_records(spark, json.loads(s.to_json()))
    assert back.records() == s.records() == s.to_pandas().to_dict("records")
    return Sheet.from_data(spark, back.cells(), headers=True).frame


@query("select 'ann' as name, 31 as age union all select 'bo, jr', 4")
def file_toon_text(spark, sf_dir):
    from .sources import tables

    name, names, cells = tables.toon_table(tables.toon_text("people", ["name", "age"], [["ann", 31], ["bo, jr", 4]]))
    return files.from_rows(spark, [names, *cells], True, files.infer.TOON).select("name", F.col("age").cast("int").alias("age"))


@query("select 'a' as k, '1' as v union all select 'b', '2'")
def text_layout_tables(spark, sf_dir):
    from .sources import tables

    (found,) = tables.text_tables("Report\n\nk  v\n----\na  1\nb  2\n\nend")
    return spark.createDataFrame(found[1:], ", ".join(f"{c} string" for c in found[0]))


@query("select event_id // 1000 as number, count(*) as n from events group by 1")
def stream_count_trigger(spark, sf_dir):
    """Every 1000 events in the order they come, over several micro-batches."""
    at = fresh_path(spark, "stream-in")
    load(spark, sf_dir, "events").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(at)
    out = fresh_path(spark, "stream-out")
    spark.createDataFrame([], "number bigint, n bigint").write.parquet(out)
    give = lambda df, _: df.groupBy(F.col(windows.FIRING).alias("number")).agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(out)
    stream = spark.readStream.schema(load(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(at)
    windows.every(stream, 1000, give, together=True).awaitTermination()
    return spark.read.schema("number bigint, n bigint").parquet(out)


def _engine(spark, sf_dir, *names: str):
    from .plans.engine import SqlEngine

    e = SqlEngine(spark)
    for n in names:
        e.register_table(n, load(spark, sf_dir, n))
    return e


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem")
def engine_sql_function(spark, sf_dir):
    e = _engine(spark, sf_dir, "lineitem")
    e.create_function("net_price", "price double, discount double", "double", "price * (1 - discount)")
    return e.query("select l_orderkey, l_linenumber, net_price(l_extendedprice, l_discount) as net from lineitem")


@query("select c_nationkey, max(c_acctbal) - min(c_acctbal) as spread from customer group by 1")
def engine_aggregate_function(spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    e.register_aggregate("spread", lambda x: float(x.max() - x.min()), "double")
    return e.query("select c_nationkey, spread(c_acctbal) as spread from customer group by c_nationkey")


@query("select n_nationkey, unnest(range(0, n_regionkey + 1))::int as k from nation")
def engine_table_function(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    e.register_table_function("upto", lambda n: ((k,) for k in range(n + 1)), "k int")
    return e.query("select n_nationkey, k from nation, lateral upto(n_regionkey)")
