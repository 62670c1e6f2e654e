"""Queries of symbols, numbers, links, quotes, structure and address search. They join `catalog.QUERIES`."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonaris.functions import legal as T
from zonaris.operators import classes as C
from zonaris.operators import search as S
from zonaris.plans.catalog import query, table

CITY = ["Łódź", "Gdańsk", "Kraków", "Świętochłowice", "Góra Kalwaria"]
STREET = ["Wąska", "Główna", "Żródlana", "Polna"]
_LIST = {"c": "['" + "','".join(CITY) + "']", "s": "['" + "','".join(STREET) + "']"}
FOLD = f"translate({{0}}, '{S.FROM}', '{S.TO}')"
ADDRESS = f"address as (select c_custkey, {_LIST['c']}[1+c_custkey%5] as city, {_LIST['s']}[1+c_custkey//5%4] as street, cast(1+c_custkey%47 as varchar) as no from customer)"


def addresses(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda names, i: F.element_at(F.array(*(F.lit(x) for x in names)), (1 + i).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", pick(CITY, k % 5).alias("city"), pick(STREET, F.expr("c_custkey div 5 % 4")).alias("street"), (1 + k % 47).cast("string").alias("no"))


@query(f"with {ADDRESS} select c_custkey, lower({FOLD.format('city')}) as city, length({FOLD.format('street')}) as n, list_aggregate(list_filter(regexp_split_to_array(lower({FOLD.format('street||chr(32)||no||chr(44)||city')}),'[^a-z0-9]+'), lambda t: t<>''), 'string_agg', '|') as tokens from address")
def folded_addresses(spark, sf_dir):
    """Labels with diacritics folded, of the same length, and their tokens."""
    d = addresses(spark, sf_dir)
    label = F.concat("street", F.lit(" "), "no", F.lit(","), "city")
    return d.select("c_custkey", S.fold(F.col("city")).alias("city"), F.length(S.fold(F.col("street"))).alias("n"), F.concat_ws("|", S.tokens(label)).alias("tokens"))


RANGES = "list_filter(range(1,length(l)+1), lambda i: len(list_filter(t, lambda w: len(list_filter(range(greatest(1,i-length(w)+1),i+1), lambda s: substr(f,s,length(w))=w))>0))>0)"


@query(f"""with {ADDRESS}, x as (select c_custkey, street||' '||no||', '||city as l, lower({FOLD.format("street||' '||no||', '||city")}) as f, ['gor','ka','wa','lodz'] as t from address), m as (select c_custkey, l, {RANGES} as i from x)
select c_custkey, coalesce(list_aggregate(list_transform(list_filter(i, lambda p: not list_contains(i,p-1)), lambda a: (a-1)||'-'||list_min(list_filter(list_append(list_transform(i, lambda p: p),0), lambda e: e>=a and not list_contains(i,e+1)))),'string_agg',','),'') as ranges from m""")
def match_ranges(spark, sf_dir):
    """Where the tokens of a query stand in each label; ranges that touch are one."""
    d = addresses(spark, sf_dir).select("c_custkey", F.concat("street", F.lit(" "), "no", F.lit(", "), "city").alias("label"))
    return d.select("c_custkey", S.match_ranges(F.col("label"), F.lit("Gor KA wa łódź x")).alias("r")).select("c_custkey", F.concat_ws(",", F.transform("r", lambda x: F.concat(x["start"], F.lit("-"), x["end"]))).alias("ranges"))


@query(f"with {ADDRESS} select c_custkey, city||', '||street||' '||no as first_variant, case when c_custkey%3=2 and city='Góra Kalwaria' then 1 else 1 end as n from address")
def address_variants(spark, sf_dir):
    """Readings of an address; towns get their diacritics back from the known names."""
    names = {x.translate(str.maketrans(S.FROM, S.TO)).lower(): x for x in CITY}
    k = F.col("c_custkey") % 3
    road, town = F.concat(F.lit("ul. "), "street", F.lit(" "), "no"), F.upper(S.fold(F.col("city")))
    text = F.when(k == 0, F.concat(road, F.lit(", "), town)).when(k == 1, F.concat(town, F.lit(",  "), road)).otherwise(F.concat(town, F.lit(" "), road))
    variants = T.arrow(lambda q: T.address_variants(q, names), "array<string>", pa.list_(pa.string()))
    return addresses(spark, sf_dir).select("c_custkey", variants(text).alias("v")).select("c_custkey", F.col("v")[0].alias("first_variant"), F.size("v").alias("n"))


SCORE = "3.0*cast(contains(f,q) as integer)+2.0*len(list_filter(t, lambda w: contains(f,w)))/len(t)"


@query(f"""with {ADDRESS}, a as (select c_custkey, lower({FOLD.format("street||' '||no||', '||city")}) as f, case c_custkey%3 when 0 then 1.0 when 1 then 0.98 else 0.96 end as conf, abs(c_custkey%100-50)/10.0 as dist, c_custkey%4<>0 as inside from address),
q as (select n_nationkey, lower({FOLD.format(f"{_LIST['s']}[1+n_nationkey%4]||' '||{_LIST['c']}[1+n_nationkey%5]")}) as q, list_filter(regexp_split_to_array(lower({FOLD.format(f"{_LIST['s']}[1+n_nationkey%4]||' '||{_LIST['c']}[1+n_nationkey%5]")}),'[^a-z0-9]+'), lambda w: length(w)>=2) as t from nation),
c as (select n_nationkey, c_custkey, q, t, f, conf, dist, inside, row_number() over (partition by n_nationkey order by len(list_intersect(t, list_filter(regexp_split_to_array(f,'[^a-z0-9]+'), lambda w: w<>''))) desc, c_custkey) as rn from q join a on len(list_intersect(t, list_filter(regexp_split_to_array(f,'[^a-z0-9]+'), lambda w: w<>'')))>0),
s as (select *, round({SCORE}+conf+1/(1+dist)+case when inside then 0.5 else -1.0 end,8) as score from c where rn<=30) select n_nationkey, c_custkey, score, cast(rank as integer) as rank from (select *, row_number() over (partition by n_nationkey order by score desc, c_custkey) as rank from s) where rank<=5""")
def address_search(spark, sf_dir):
    """Candidates by shared tokens, at most min(100, max(6 * limit, 30)) of them, ranked again by text, kind, distance and box."""
    a = addresses(spark, sf_dir)
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "city").when(k % 3 == 1, "street").otherwise("house_number")
    a = a.select("c_custkey", F.concat("street", F.lit(" "), "no", F.lit(", "), "city").alias("label"), kind.alias("kind"), (F.abs(k % 100 - 50) / 10).alias("dist"), (k % 4 != 0).alias("inside"))
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (1 + F.col("n_nationkey") % n).cast("int"))
    q = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(pick(STREET, 4), F.lit(" "), pick(CITY, 5)).alias("query"))
    found = S.search(q, "n_nationkey", a, "c_custkey", 5, "kind", F.col("dist"), F.col("inside"))
    return found.select("n_nationkey", "c_custkey", "score", "rank")


@query("select c_custkey, sha256('{\"c_acctbal_cents\":'||cast(round(c_acctbal*100) as bigint)||',\"c_mktsegment\":\"'||c_mktsegment||'\",\"c_name\":\"'||c_name||'\"}') as hash from customer")
def canonical_json(spark, sf_dir):
    """JSON with its keys in order, and its hash."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("c_acctbal_cents"))
    return c.select("c_custkey", S.canonical_hash(*(x for x in c.columns if x != "c_custkey")).alias("hash"))


RAW = ["' 12  mn '", "'MN/U'", "''", "'A'||chr(9)||'B'", "'x;y'", "repeat('A',41)", "'１２ＭＮ'", "null"]


@query("""select p_partkey, case p_partkey%8 when 0 then '12 mn' when 1 then 'MN/U' when 6 then '12MN' end as symbol, case p_partkey%8 when 0 then '12mn' when 1 then 'mn/u' when 6 then '12mn' end as key,
case p_partkey%8 when 2 then 'empty' when 3 then 'control_characters' when 4 then 'disallowed_characters' when 5 then 'too_long' when 7 then 'empty' end as reason from part""")
def zone_symbols(spark, sf_dir):
    """Canonical zone symbols, their keys, and why a symbol is refused."""
    raw = [" 12  mn ", "MN/U", "", "A\tB", "x;y", "A" * 41, "１２ＭＮ", None]
    k = (F.col("p_partkey") % 8 + 1).cast("int")
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*(F.lit(x) for x in raw)), k).alias("raw"))
    return p.select("p_partkey", T.symbol("raw").alias("s")).select("p_partkey", "s.*")


@query("select p_partkey, 2*(p_partkey%5)+21 as first_place, 1 as n, case when p_partkey%2=0 then 2 else 1 end as n_tolerant from part")
def symbol_mentions(spark, sf_dir):
    """X11: places of a symbol as a whole token, not as the tail of another; a tolerant search also takes what a scan confuses."""
    k = F.col("p_partkey")
    text = F.concat(F.repeat(F.lit("a "), (k % 5).cast("int")), F.lit("tereny 146 U1, U1.2, U1 oraz MW/U1; "), F.when(k % 2 == 0, "Ul").otherwise("Ux"))
    d = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    d = d.select("p_partkey", T.mentions("t", F.lit("U1"), F.lit(False)).alias("m"), T.mentions("t", F.lit("U1"), F.lit(True)).alias("o"))
    return d.select("p_partkey", F.col("m")[0]["start"].cast("int").alias("first_place"), F.size("m").alias("n"), F.size("o").alias("n_tolerant"))


@query("select p_partkey, case p_partkey%4 when 0 then 1+p_partkey%9 when 1 then 3 end as n, case p_partkey%4 when 0 then (1+p_partkey%9)||'KDZ' when 1 then 'MW.3' end as last from part")
def symbol_ranges(spark, sf_dir):
    """Ranges of symbols written out."""
    k = F.col("p_partkey")
    token = F.when(k % 4 == 0, F.concat(F.lit("1KDZ-"), 1 + k % 9, F.lit("KDZ"))).when(k % 4 == 1, "MW.1 – MW.3").when(k % 4 == 2, "10-12").otherwise("5MN-2MN")
    return table(spark, sf_dir, "part").select("p_partkey", T.symbol_range(token).alias("r")).select("p_partkey", F.when(F.col("r").isNotNull(), F.size("r")).alias("n"), F.element_at("r", -1).alias("last"))


@query("select p_partkey, case p_partkey%6 when 0 then 'housing' when 1 then 'services' when 2 then 'green' when 3 then 'roads' when 4 then 'other' else 'housing' end as category from part")
def symbol_categories(spark, sf_dir):
    """What a symbol's letters stand for."""
    k = F.col("p_partkey") % 6
    s = F.when(k == 0, "12.MN").when(k == 1, "U/P").when(k == 2, "1ZP").when(k == 3, "KDZ").when(k == 4, "77").otherwise("3 mw")
    return table(spark, sf_dir, "part").select("p_partkey", T.category(s).alias("category"))


@query("select o_orderkey, case when o_orderkey%3<2 then 'XII/'||o_orderkey||'/2019' end as number, case o_orderkey%4 when 3 then null else strftime(o_orderdate,'%Y-%m-%d') end as day from orders")
def resolutions(spark, sf_dir):
    """Numbers and days of resolutions in their different spellings."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    month = F.element_at(F.array(*(F.lit(m) for m in T.MONTHS)), F.month(d))
    day = F.when(k % 4 == 0, F.concat_ws(" ", F.dayofmonth(d), month, F.year(d), F.lit("r."))).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(d, "dd.MM.yyyy")).otherwise("kiedyś")
    head = F.when(k % 3 == 0, F.concat(F.lit("Nr XII/"), k, F.lit("/2019"))).when(k % 3 == 1, F.concat(F.lit("uchwała nr xii / "), k, F.lit(" / 2019"))).otherwise("bez numeru")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.resolution(F.concat(head, F.lit(" z dnia "), day)).alias("r")).select("o_orderkey", "r.number", F.col("r.day").cast("string").alias("day"))


@query("select page_id, 'https://'||regexp_replace(regexp_replace(regexp_replace(url,'^https?://(www[.])?',''),'#.*$',''),'/$','') as link from pages where url is not null and not contains(url,'?') union all select page_id, 'https://'||replace(regexp_replace(regexp_replace(url,'^https?://(www[.])?',''),'#.*$',''),'/?','?') from pages where contains(url,'?')")
def links(spark, sf_dir):
    """Links in a form for comparison."""
    k, u = F.col("page_id"), F.col("url")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), F.regexp_replace(u, r"^https?://(www\.)?", "HTTP://www."))).otherwise(u)
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", T.link(raw).alias("link"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'in_force' when 'O' then 'in_progress' else 'unknown' end as status, o_orderstatus='P' as mapped_late from orders")
def status_codes(spark, sf_dir):
    """Status codes of several spellings as one list; what is not listed is unknown."""
    codes = {"f": "in_force", "obowiązujący": "in_force", "01": "in_force", "o": "in_progress", "w opracowaniu": "in_progress"}
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    raw = F.when((s == "F") & (k % 3 == 0), " Obowiązujący").when((s == "F") & (k % 3 == 1), "01").when((s == "O") & (k % 2 == 0), "W opracowaniu ").otherwise(s)
    names = F.create_map(*(x for c, n in codes.items() for x in (F.lit(c), F.lit(n))))
    status = F.coalesce(names[F.lower(F.trim(raw))], F.lit("unknown"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), (status == "unknown").alias("mapped_late"))


@query("select p_partkey, 'teren '||p_name||' zabudowy' as text, 3*(p_partkey%2)+6 as name_place, case when p_partkey%2=1 then 'hyphen,spaces' else 'hyphen' end as flags from part")
def normalized_texts(spark, sf_dir):
    """Text mended of broken words and spaces, with the place that each character came from."""
    k = F.col("p_partkey")
    raw = F.concat(F.when(k % 2 == 1, "   teren").otherwise("teren"), F.lit(" "), F.col("p_name"), F.lit(" zabu-\ndowy"))
    d = table(spark, sf_dir, "part").select("p_partkey", T.normalized(raw).alias("n"))
    return d.select("p_partkey", "n.text", F.col("n.places")[6].alias("name_place"), F.concat_ws(",", "n.flags").alias("flags"))


@query("select p_partkey, 9 as start, 9+length(p_name)+case p_partkey%2 when 1 then 2 else 1 end+5 as \"end\", case when p_partkey%3=0 then null else 9 end as near_start, case when p_partkey%3=0 then null else 1 end as edits from part")
def quote_places(spark, sf_dir):
    """Where a quote stands, equal but for white space, and with few edits; digits must agree."""
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.concat(F.lit("wstęp -- "), name, F.when(k % 2 == 1, "  ").otherwise(" "), F.lit("12345"), F.lit(" koniec"))
    wrong = F.concat(F.lit("?"), F.substring(name, 2, 50), F.when(k % 2 == 1, "  ").otherwise(" "), F.when(k % 3 == 0, "12346").otherwise("12345"))
    d = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.concat(name, F.lit(" 12345")).alias("quote"), wrong.alias("wrong"))
    found = lambda v: v.select(C.SAME, T.quote_place("text", "quote").alias("q"), T.near_quote("text", "wrong", F.lit(1)).alias("n"))
    d = C.each(d, ["text", "quote", "wrong"], found)  # equal texts and quotes are looked up once
    return d.select("p_partkey", F.col("q.start").cast("int").alias("start"), F.col("q.end").cast("int").alias("end"), F.col("n.start").cast("int").alias("near_start"), F.col("n.edits").cast("int").alias("edits"))


@query("select p_partkey, case when length(p_name)>8 then rtrim(substr(p_name,1,7))||'…' else p_name end as short, 'call?token=***&x=1 Bearer ***' as masked, replace(p_name,' ','_')||'_'||p_partkey||'.pdf' as file from part")
def clipped_and_masked(spark, sf_dir):
    """Clipped labels, masked secrets, safe file names."""
    p = table(spark, sf_dir, "part")
    secret = F.concat(F.lit("call?token="), F.col("p_partkey"), F.lit("abc&x=1 Bearer "), F.md5("p_name"))
    return p.select("p_partkey", T.clipped(F.col("p_name"), 8).alias("short"), T.masked(secret).alias("masked"), T.file_name(F.concat(F.lit("../"), "p_name", F.lit(" / "), "p_partkey", F.lit(".pdf"))).alias("file"))


@query("select p_partkey, case p_partkey%5 when 0 then 1234.5 when 1 then 3 when 2 then 2 when 3 then 5 end + case when p_partkey%5=4 then null else 0.0 end as least, case p_partkey%5 when 0 then 1234.5 when 1 then 5 when 2 then 4.5 when 3 then 5 end + 0.0 as most from part")
def locale_numbers(spark, sf_dir):
    """Numbers of a locale, ranges and number words."""
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, "1 234,5").when(k == 1, "3-5").when(k == 2, "od 2 do 4,5").when(k == 3, "Pięć").otherwise("8-2")
    return table(spark, sf_dir, "part").select("p_partkey", T.number_of(t).alias("n")).select("p_partkey", "n.*")


RANKS = [("chapter", r"^\s*Rozdział\s+(\S+)"), ("section", r"^\s*§\s*(\d+)"), ("paragraph", r"^\s*(\d+)\.\s"), ("point", r"^\s*(\d+)\)\s")]


def _acts(spark, sf_dir) -> DataFrame:
    """A short act for each supplier: chapters, sections, paragraphs, points; the number of sections varies."""
    k = F.col("s_suppkey")
    section = F.transform(F.sequence(F.lit(1), (1 + k % 3).cast("int")), lambda i: F.concat(F.lit("§ "), i, F.lit("\n1. Wysokość do "), i + 8, F.lit(" m:\n1) dach\n2) ściany\n2. Zakaz reklam")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Tytuł\nRozdział I\n"), F.array_join(section, "\n"), F.lit("\nRozdział II\n§ 9\nKoniec")).alias("text"))


@query("""with s as (select s_suppkey, 1+s_suppkey%3 as n from supplier), l as (select s_suppkey, i*5+2+j as line, i+1 as sec, j from s, range(0,3) r(i), range(0,5) q(j) where i<n)
select s_suppkey, line, ['section','paragraph','point','point','paragraph'][1+j] as kind, case j when 0 then 1 when 1 then line-1 when 2 then line-1 when 3 then line-2 else line-4 end as parent, 'I'||case when j>0 then '/'||sec else '' end||case when j in (2,3) then '/1' else '' end as path from l
union all select s_suppkey, 0, 'text', null, '' from s union all select s_suppkey, 1, 'chapter', null, '' from s union all select s_suppkey, 2+5*n, 'chapter', null, '' from s union all select s_suppkey, 3+5*n, 'section', 2+5*n, 'II' from s union all select s_suppkey, 4+5*n, 'text', 3+5*n, 'II/9' from s""")
def legal_units(spark, sf_dir):
    """Chapters, sections, paragraphs and points as a tree that tiles the text."""
    d = T.nested(T.lines_of(_acts(spark, sf_dir), "s_suppkey", "text", RANKS), "s_suppkey", len(RANKS))
    return d.select("s_suppkey", "line", "kind", "parent", "path")


@query("with t as (select s_suppkey, sum(i+8) as total, count(*) as n from supplier, range(1,4) r(i) where i<=1+s_suppkey%3 group by 1) select s_suppkey, cast(total as double) as total, n, n as bans from t")
def rules_of_units(spark, sf_dir):
    """Rules read from the units: heights in metres, bans; each with the path of its unit."""
    d = T.nested(T.lines_of(_acts(spark, sf_dir), "s_suppkey", "text", RANKS), "s_suppkey", len(RANKS))
    r = d.where("kind = 'paragraph'").select("s_suppkey", "path", F.regexp_extract("body", r"do (\d+) m", 1).try_cast("double").alias("height"), F.col("body").rlike("(?i)zakaz").alias("ban"))
    return r.groupBy("s_suppkey").agg(F.sum("height").alias("total"), F.count("height").alias("n"), F.count_if("ban").alias("bans"))


@query("select doc_id, true as covers, true as bounded from documents where text is not null and text<>''")
def text_chunks(spark, sf_dir):
    """Overlapping chunks with cuts at line, sentence and word ends; they cover each text and none is too long."""
    c = T.chunks_of(table(spark, sf_dir, "documents"), "doc_id", "text", 800, 80)
    w = Window.partitionBy("doc_id").orderBy("chunk")
    c = c.withColumn("gap", F.col("start") > F.lag("end", 1, 0).over(w))
    g = c.groupBy("doc_id").agg(F.bool_or("gap").alias("gap"), F.max("end").alias("end"), F.max(F.col("end") - F.col("start")).alias("most"))
    n = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return g.join(n, "doc_id").select("doc_id", (~F.col("gap") & (F.col("end") == F.col("n"))).alias("covers"), (F.col("most") <= 800).alias("bounded"))
