"""Queries of packages, feature collections, document scopes, quantities and candidate checks. They join `catalog.QUERIES`."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonaris.functions import geometry as G
from zonaris.functions import legal as T
from zonaris.functions import numbers as N
from zonaris.functions import planar as L
from zonaris.operators import classes as C
from zonaris.operators import polygons as P
from zonaris.plans.catalog import CELL, query, table
from zonaris.plans.polygons import MEET, SQUARE, parcels, zones
from zonaris.sources import packages as K


def _suppliers(spark, sf_dir) -> DataFrame:
    """Suppliers dealt to many tasks: the file is small, the package made of a row and read again is not."""
    return C.wide(table(spark, sf_dir, "supplier"), "s_suppkey")


def _zipped(*names: str):
    """A column of ZIP bytes from text columns, one member each."""

    def pack(*texts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in zip(names, texts, strict=True):
                if t is not None:
                    z.writestr(n, t)
        return out.getvalue()

    return T.arrow(pack, "binary", pa.binary())


@query("""select s_suppkey, 'roads/a.xml' as member, null::varchar as reason, length('<r><a><no>'||s_suppkey||'</no></a></r>') as n from supplier union all select s_suppkey, '../evil.xml', 'unsafe_path', null from supplier where s_suppkey%2=0
union all select s_suppkey, 'big.xml', 'ratio_too_high', null from supplier where s_suppkey%5=0""")
def archive_members(spark, sf_dir):
    """Members of ZIP packages under limits; what is refused is told."""
    k = F.col("s_suppkey")
    xml = F.concat(F.lit("<r><a><no>"), k, F.lit("</no></a></r>"))
    large = io.BytesIO()  # an archive of the large member alone, deflated once; the others are added to it
    with zipfile.ZipFile(large, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.xml", b"0" * 5_000_000)
    large = large.getvalue()

    def pack(text, evil, big):
        out = io.BytesIO(large if big else b"")
        with zipfile.ZipFile(out, "a" if big else "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("roads/a.xml", text), z.writestr("readme.txt", "x")
            if evil:
                z.writestr("../evil.xml", "x")
        return out.getvalue()

    packed = T.arrow(pack, "binary", pa.binary())(xml, k % 2 == 0, k % 5 == 0)
    d = K.unzip(_suppliers(spark, sf_dir).select(k.cast("string").alias("path"), packed.alias("content")), [".xml"])
    return d.select(F.col("path").cast("bigint").alias("s_suppkey"), "member", "reason", F.octet_length("content").alias("n"))


@query("select s_suppkey, i as no, 'Wola '||i as city, case when i%2=0 then 'Polna' end as street from supplier, range(0,4) r(i) where i<=s_suppkey%4")
def zipped_addresses(spark, sf_dir):
    """Address elements of XML members of ZIP packages, element by element."""
    k = F.col("s_suppkey")
    one = lambda i: F.concat(F.lit("<a:adres><a:no>"), i, F.lit("</a:no><a:miejsce><a:city>Wola "), i, F.lit("</a:city></a:miejsce>"), F.when(i % 2 == 0, "<a:street>Polna</a:street>").otherwise(""), F.lit("</a:adres>"))
    xml = F.concat(F.lit('<x xmlns:a="urn:a">'), F.array_join(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), one), ""), F.lit("</x>"))
    files = _suppliers(spark, sf_dir).select(k.cast("string").alias("path"), _zipped("adresy.xml")(xml).alias("content"))
    d = K.read_elements(K.unzip(files, [".xml"]).where("reason is null").select("path", "content"), "adres", ["no", "city", "street"])
    return d.select(F.col("path").cast("bigint").alias("s_suppkey"), F.col("no").cast("bigint").alias("no"), "city", "street")


def _gml(spark, sf_dir) -> DataFrame:
    """A GML collection for each supplier: one zone, axes north then east, nested properties; every seventh is cut off."""
    k = F.col("s_suppkey")
    lat, lon = 50 + k % 100 / 100, 19 + k % 80 / 100
    at = lambda a, b: F.concat_ws(" ", lat + a, lon + b)
    ring = F.concat_ws(" ", at(0, 0), at(0, 0.01), at(0.01, 0.01), at(0.01, 0), at(0, 0))
    xml = F.concat(F.lit('<c xmlns:gml="urn:gml"><member><Zone gml:id="z'), k, F.lit('"><symbol>MN</symbol><act><no>'), k % 9, F.lit("</no></act><geom><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), ring, F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></geom></Zone></member>"), F.when(k % 7 == 3, "").otherwise("</c>"))
    return _suppliers(spark, sf_dir).select(k.cast("string").alias("path"), xml.cast("binary").alias("content"))


@query("select s_suppkey, 'z'||s_suppkey as id, 'MN' as symbol, cast(s_suppkey%9 as varchar) as act_no, round(19+s_suppkey%80/100.0,6) as x0, round(50+s_suppkey%100/100.0,6) as y0, null::varchar as reason from supplier union all select s_suppkey, null, null, null, null, null, 'not_well_formed' from supplier where s_suppkey%7=3")
def gml_features(spark, sf_dir):
    """GML features with swapped axes and nested properties by dotted path; a broken document is told."""
    d = P.boxed(K.read_gml(_gml(spark, sf_dir), "Zone", swap=True))
    return d.select(F.col("path").cast("bigint").alias("s_suppkey"), "id", F.col("props")["symbol"].alias("symbol"), F.col("props")["act.no"].alias("act_no"), F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"), "reason")


@query("select s_suppkey, true as same from supplier")
def reprojected_features(spark, sf_dir):
    """Rings in the plane system, equal to the projection of each point by columns."""
    d = K.read_gml(_gml(spark, sf_dir), "Zone", swap=True).where("reason is null").select("path", "shape", K.reprojected(F.col("shape")).alias("plane"))
    ring, plane = F.col("shape")[0], F.col("plane")[0]
    x, y = N.to_plane(ring[0], ring[1])
    return d.select(F.col("path").cast("bigint").alias("s_suppkey"), ((F.abs(plane[0] - x) < 1e-6) & (F.abs(plane[1] - y) < 1e-6)).alias("same"))


@query("""with f as (select s_nationkey as act, count(*) as zones, count(distinct s_suppkey%3) as layers from supplier where s_suppkey%5<>0 group by 1), d as (select c_nationkey as act, count(*) as documents from customer where c_custkey%50=7 group by 1)
select n_nationkey as act, n_name as title, coalesce(zones,0) as zones, coalesce(layers,0) as layers, coalesce(documents,0) as documents, zones is not null and documents is not null as complete from nation left join f on f.act=n_nationkey left join d on d.act=n_nationkey""")
def assembled_acts(spark, sf_dir):
    """Acts put together from several layers of features and their documents."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0")
    layers = [s.where(F.col("s_suppkey") % 3 == i).select(F.col("s_nationkey").alias("act"), F.lit(f"layer{i}").alias("layer")) for i in range(3)]
    docs = table(spark, sf_dir, "customer").where("c_custkey % 50 = 7").select(F.col("c_nationkey").alias("act"))
    acts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("act"), F.col("n_name").alias("title"))
    return K.assembled_acts(layers[0].unionByName(layers[1]).unionByName(layers[2]), docs, acts, "act")


@query("select s_suppkey, 'Plan '||s_suppkey as title, case when s_suppkey%4>0 then 1+s_suppkey%3 else 0 end as keywords, s_nationkey as act from supplier")
def metadata_records(spark, sf_dir):
    """ISO metadata records by XPath, attached to acts."""
    k = F.col("s_suppkey")
    words = F.when(k % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(1), (1 + k % 3).cast("int")), lambda i: F.concat(F.lit("<keyword>k"), i, F.lit("</keyword>"))), "")).otherwise("")
    d = table(spark, sf_dir, "supplier").select(k, "s_nationkey", F.concat(F.lit("<MD_Metadata><identification><title>Plan "), k, F.lit("</title>"), words, F.lit("</identification></MD_Metadata>")).alias("xml"))
    d = d.select("s_suppkey", "s_nationkey", F.xpath_string("xml", F.lit("MD_Metadata/identification/title")).alias("title"), F.size(F.xpath("xml", F.lit("//keyword/text()"))).alias("keywords"))
    return d.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "title", "keywords", F.col("n_nationkey").alias("act"))


@query("""select s_suppkey, 0 as record, case s_suppkey%3 when 1 then 'k1' else 'v'||s_suppkey end as value, 2 as n from supplier union all select s_suppkey, 1, case s_suppkey%3 when 0 then 'out' else 'k2' end, case s_suppkey%3 when 0 then 1 else 2 end from supplier where s_suppkey%3<2""")
def feature_info(spark, sf_dir):
    """Feature-info answers: tables inside tables, keys and values, rows under a header, JSON."""
    k = F.col("s_suppkey")
    nested = F.concat(F.lit("<table><tr><td>a</td><td>out<table><tr><td>a</td><td>v"), k, F.lit("</td></tr><tr><th>b</th><td> x\n y</td></tr></table></td></tr></table>"))
    wide = "<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>k1</td><td>2</td></tr><tr><td>k2</td><td>4</td></tr></table>"
    js = F.concat(F.lit('{"features":[{"properties":{"a":"v'), k, F.lit('","b":null}}]}'))
    text = F.when(k % 3 == 0, nested).when(k % 3 == 1, wide).otherwise(js)
    d = K.feature_info(_suppliers(spark, sf_dir).select(k, text.alias("t")), "s_suppkey", "t")
    return d.select("s_suppkey", "record", F.col("props")["a"].alias("value"), F.size("props").alias("n"))


@query("select s_suppkey, 'p'||s_suppkey as id, 'c'||s_nationkey as commune, case s_suppkey%2 when 0 then 'POINT(1 2)' end as wkt from supplier where s_suppkey%5<>4")
def protocol_lines(spark, sf_dir):
    """Lines of the parcel protocol; an answer with an error code gives none."""
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 5 == 4, "-1 no result\n").otherwise("0\n"), F.lit("p"), k, F.lit("|c"), "s_nationkey", F.when(k % 2 == 0, "|POINT(1 2)\n").otherwise("\r\n"))
    return table(spark, sf_dir, "supplier").select(k, F.inline(K.lookup_lines(text)))


@query("select * from (values ('roads','https://a.example/roads',24,null),('zones','https://a.example/zones',24,null),('old','http://a.example/x',24,'not_https'),('bad','https://a.example/y',-1,'bad_interval'),('roads','https://b.example/r',24,'duplicate_id')) t(id,url,hours,reason)")
def source_catalog(spark, sf_dir):
    """The catalogue of sources as a table, each entry with the reason why it is not used."""
    rows = [("roads", "https://a.example/roads", 24, 1), ("zones", "https://a.example/zones", 24, 2), ("old", "http://a.example/x", 24, 3), ("bad", "https://a.example/y", -1, 4), ("roads", "https://b.example/r", 24, 5)]
    d = spark.createDataFrame(rows, "id string, url string, hours int, turn int")
    first = F.row_number().over(Window.partitionBy("id").orderBy("turn")) == 1
    return d.select("id", "url", "hours", F.when(~first, "duplicate_id").when(~F.col("url").startswith("https://"), "not_https").when(F.col("hours") <= 0, "bad_interval").alias("reason"))


@query("select doc_id, octet_length(encode(text)) as n_bytes, sha256(text) as sha256, true as sound from documents where text is not null")
def zip_sink(spark, sf_dir):
    """Documents packed into ZIP archives with a manifest, read back and verified; the same rows give the same bytes."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("doc-%010d.txt", "doc_id").alias("name"), F.col("text").alias("body"))
    z = K.zip_archives(docs, "name", "body", 200_000)
    listed = z.select("archive", F.inline("manifest"))
    held = K.unzip(z.select(F.col("archive").alias("path"), "content")).select(F.col("path").alias("archive"), F.col("member").alias("name"), F.sha2("content", 256).alias("held"))
    d = listed.join(held, ["archive", "name"], "full")
    return d.select(F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("doc_id"), "n_bytes", "sha256", (F.col("sha256") == F.col("held")).alias("sound"))


@query("select (s_suppkey*53%1000)//100 as tx, (s_suppkey*29%1000)//100 as ty, 'l'||s_suppkey%2 as layer, count(*) as n, true as sound from supplier group by all")
def vector_tiles(spark, sf_dir):
    """Encoded vector tiles with counts by layer; the encoded features are counted again."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x, y = k * 53 % 1000, k * 29 % 1000
    p = s.select(k.alias("id"), F.floor(x / 100).alias("tx"), F.floor(y / 100).alias("ty"), (x % 100 * 40).cast("int").alias("px"), (y % 100 * 40).cast("int").alias("py"), F.concat(F.lit("l"), k % 2).alias("layer"))

    def features(raw):
        """Fields 2 of the layer in field 3."""
        def read(b, at):
            n = shift = 0
            while True:
                n |= (b[at] & 127) << shift
                shift += 7
                at += 1
                if b[at - 1] < 128:
                    return n, at

        tag, at = read(raw, 0)
        size, at = read(raw, at)
        end, n = at + size, 0
        while at < end:
            tag, at = read(raw, at)
            v, at = read(raw, at)
            n += tag == (2 << 3 | 2)
            at += v if tag & 7 == 2 else 0
        return n

    t = K.vector_tiles(p, 12, "layer")
    t = t.withColumn("counted", T.arrow(features, "bigint", pa.int64())("tile"))
    return t.groupBy("tx", "ty", "layer").agg(F.sum("n").alias("n"), (F.sum("n") == F.sum("counted")).alias("sound"))


_HALF = "case when s%2=0 then cast({0}+s//2 as varchar) else cast({0}+s//2 as varchar)||'.5' end"
_HX, _HY = _HALF.format("x"), _HALF.format("y")


@query(f"""with {SQUARE} select c_custkey, '{{"type":"Feature","id":'||c_custkey||',"geometry":{{"type":"Polygon","coordinates":[[['||x||','||y||'],['||(x+s)||','||y||'],['||(x+s)||','||{_HY}||'],['||{_HX}||','||{_HY}||'],['||{_HX}||','||(y+s)||'],['||x||','||(y+s)||'],['||x||','||y||']]]}}}}' as feature from square""")
def geojson_polygons(spark, sf_dir):
    """Features with their shape as GeoJSON: rings closed, shells against the clock."""
    d = C.each(parcels(spark, sf_dir), ["shape"], lambda v: v.withColumn("geometry", L.geojson("shape")))
    return d.select("c_custkey", F.concat(F.lit('{"type":"Feature","id":'), "c_custkey", F.lit(',"geometry":'), "geometry", F.lit("}")).alias("feature"))


def _plan(spark, sf_dir) -> DataFrame:
    """A plan of two zone sections for each supplier."""
    k = F.col("s_suppkey")
    one = F.concat(F.lit("§ 1 Dla terenów oznaczonych symbolami 1MN, 2MN ustala się:\n1. Wysokość zabudowy do "), 8 + k % 5, F.lit(",5 m\n2. Zakaz reklam, w strefie A\n"))
    two = F.concat(F.lit("§ 2 Dla terenu oznaczonego symbolem "), k % 3 + 1, F.lit("U ustala się:\n1. Powierzchnia biologicznie czynna 0,"), 25 + k % 10, F.lit(" ha albo "), 20 + k % 40, F.lit(" %\n2. Dopuszcza się usługi"))
    return table(spark, sf_dir, "supplier").select(k, F.concat(one, two).alias("text"))


SECTION = [("section", r"^\s*§\s*(\d+)"), ("paragraph", r"^\s*(\d+)\.\s")]


def _scoped(spark, sf_dir) -> DataFrame:
    """Lines of the plans with the symbols of the section that they stand in."""
    d = T.nested(T.lines_of(_plan(spark, sf_dir), "s_suppkey", "text", SECTION), "s_suppkey", 2)
    found = F.when(F.col("kind") == "section", F.regexp_extract_all("body", F.lit(r"(\d+[A-Z]{1,3})\b"), 1))
    w = Window.partitionBy("s_suppkey").orderBy("line")
    return d.withColumn("symbols", F.last(found, True).over(w))


@query("select s_suppkey, 1 as section, '1MN' as symbol, 2 as blocks from supplier union all select s_suppkey, 1, '2MN', 2 from supplier union all select s_suppkey, 2, (s_suppkey%3+1)||'U', 2 from supplier")
def zone_scopes(spark, sf_dir):
    """Sections of zones, the symbols that they name, and the blocks that belong to each symbol."""
    d = _scoped(spark, sf_dir).where("kind = 'paragraph'").select("s_suppkey", F.element_at(F.split("path", "/"), 1).cast("int").alias("section"), F.explode("symbols").alias("symbol"))
    return d.groupBy("s_suppkey", "section", "symbol").agg(F.count("*").cast("int").alias("blocks"))


@query("""select s_suppkey, 8.5+s_suppkey%5 as value, 'm' as unit, 'height' as family, 8.5+s_suppkey%5 as normal from supplier union all select s_suppkey, (25+s_suppkey%10)/100.0, 'ha', 'area', (25+s_suppkey%10)*100.0 from supplier
union all select s_suppkey, 20.0+s_suppkey%40, '%', 'share', (20.0+s_suppkey%40)/100 from supplier""")
def text_quantities(spark, sf_dir):
    """Quantities of the plans with unit and family, normalised to metres, square metres and shares."""
    d = _scoped(spark, sf_dir).where("kind = 'paragraph'")
    q = d.select("s_suppkey", F.explode(F.regexp_extract_all("body", F.lit(r"(\d+(?:,\d+)? ?(?:ha|m²|m|%))"), 1)).alias("raw"))
    value, unit = F.regexp_replace(F.regexp_extract("raw", r"^([\d,]+)", 1), ",", ".").try_cast("double"), F.regexp_extract("raw", r"(ha|m²|m|%)$", 1)
    q = q.select("s_suppkey", value.alias("value"), unit.alias("unit"))
    family = F.when(F.col("unit") == "m", "height").when(F.col("unit").isin("ha", "m²"), "area").otherwise("share")
    normal = F.col("value") * F.when(F.col("unit") == "ha", 10000.0).when(F.col("unit") == "%", 0.01).otherwise(1.0)
    return q.select("s_suppkey", F.round("value", 6).alias("value"), "unit", family.alias("family"), F.round(normal, 6).alias("normal"))


@query("select s_suppkey, 'prohibition' as kind, '1MN' as symbol, 'area=a|where=strefa' as conditions from supplier union all select s_suppkey, 'prohibition', '2MN', 'area=a|where=strefa' from supplier union all select s_suppkey, 'permission', (s_suppkey%3+1)||'U', '' from supplier")
def descriptive_findings(spark, sf_dir):
    """Prohibitions and permissions by symbol, with the key of their conditions."""
    d = _scoped(spark, sf_dir).where("kind = 'paragraph'")
    kind = F.when(F.col("body").rlike("(?i)zakaz|zakazuje"), "prohibition").when(F.col("body").rlike("(?i)dopuszcza"), "permission")
    area = F.lower(F.regexp_extract("body", r"w strefie ([A-Z])\b", 1))
    conditions = F.sort_array(F.filter(F.array(F.when(area != "", F.concat(F.lit("area="), area)), F.when(area != "", "where=strefa")), lambda x: x.isNotNull()))
    d = d.select("s_suppkey", kind.alias("kind"), F.explode("symbols").alias("symbol"), F.concat_ws("|", conditions).alias("conditions"))
    return d.where("kind is not null")


#: Gates of a candidate in their order.
GATES = ("parameter", "operator", "quote", "raw_value", "value", "range", "scope", "duplicate")


@query("""select s_suppkey, c, case c when 0 then null when 1 then 'parameter' when 2 then 'operator' when 3 then 'quote' when 4 then 'raw_value' when 5 then 'value' when 6 then 'range' when 7 then 'scope' else 'duplicate' end as gate from supplier, range(0,9) t(c)""")
def candidate_gates(spark, sf_dir):
    """Candidates against eight gates in order; the first that fails is told, only the first of equal ones passes."""
    k = F.col("s_suppkey")
    height = F.concat(8 + k % 5, F.lit(",5"))
    d = _plan(spark, sf_dir).select(k, "text", height.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("c"))
    c = F.col("c")
    raw = F.when(c == 4, "99").when(c == 6, "0").otherwise(F.col("h"))
    quote = F.when(c == 3, "Wysokość do 99 m").when(c == 6, F.concat(F.lit("§ 1 Dla terenów"), F.lit(""))).otherwise(F.concat(F.lit("Wysokość zabudowy do "), F.col("h"), F.lit(" m")))
    raw = F.when(c == 6, "1").otherwise(raw)
    cand = F.struct(F.when(c == 1, "color").otherwise("height").alias("parameter"), F.when(c == 2, "~").otherwise("<=").alias("operator"), quote.alias("quote"), raw.alias("raw"), F.when(c == 5, 7.0).when(c == 6, 1.0).otherwise(F.regexp_replace("h", ",", ".").cast("double")).alias("value"), F.when(c == 7, "9ZZ").otherwise("1MN").alias("symbol"))
    payload = F.to_json(cand)
    kind = "parameter string, operator string, quote string, raw string, value double, symbol string"
    d = d.select(k, "c", "text", F.from_json(payload, kind, {"mode": "PERMISSIVE"}).alias("p"))
    value = F.regexp_replace("p.raw", ",", ".").try_cast("double")
    fails = [
        ~F.col("p.parameter").isin("height", "share", "area"), ~F.col("p.operator").isin("<=", ">=", "="), ~F.contains("text", "p.quote"),
        ~F.contains("p.quote", "p.raw"), F.col("p.value") != value, ~F.col("p.value").between(2, 400), ~F.contains("text", "p.symbol"),
    ]
    gate = F.lit(None).cast("string")
    for name, bad in reversed(list(zip(GATES, fails, strict=False))):
        gate = F.when(bad, name).otherwise(gate)
    d = d.withColumn("gate", gate)
    first = F.row_number().over(Window.partitionBy("s_suppkey", F.col("gate").isNull(), "p.parameter", "p.operator", "p.value", "p.symbol", "p.quote").orderBy("c"))
    return d.withColumn("n", first).select("s_suppkey", "c", F.when(F.col("gate").isNull() & (F.col("n") > 1), "duplicate").otherwise(F.col("gate")).alias("gate"))


@query("""with r as (select s_suppkey%50 as z, s_suppkey%4 as p, max(s_acctbal) as v from supplier where s_suppkey%3<>1 group by all), c as (select s_suppkey%50 as z, s_suppkey%4 as p, max(s_acctbal) as v from supplier where s_suppkey%5<>1 group by all)
select coalesce(r.z,c.z) as z, coalesce(r.p,c.p) as p, coalesce(r.v,c.v) as v, case when c.v is null then 'rules' when r.v is null then 'candidate' when r.v=c.v then 'both' else 'conflict' end as origin, coalesce(r.v<>c.v,false) as review from r full join c on r.z=c.z and r.p=c.p""")
def merged_candidates(spark, sf_dir):
    """Verified candidates beside the values of rules; a rule's value stays, a candidate fills what is missing, a conflict is for review."""
    s = table(spark, sf_dir, "supplier")
    of = lambda c, n: s.where(c).groupBy((F.col("s_suppkey") % 50).alias("z"), (F.col("s_suppkey") % 4).alias("p")).agg(F.max("s_acctbal").alias(n))
    d = of("s_suppkey % 3 <> 1", "r").join(of("s_suppkey % 5 <> 1", "c"), ["z", "p"], "full")
    origin = F.when(F.col("c").isNull(), "rules").when(F.col("r").isNull(), "candidate").when(F.col("r") == F.col("c"), "both").otherwise("conflict")
    return d.select("z", "p", F.coalesce("r", "c").alias("v"), origin.alias("origin"), F.coalesce(F.col("r") != F.col("c"), F.lit(False)).alias("review"))


@query(f"""with {MEET}, z as (select c_custkey, count(*) filter (where a>1e-6) as zones, max(a) as top, sum(a) as total, max(whole) as whole, bool_or(a<=1e-6) as touch from met group by 1)
select q.c_custkey, coalesce(zones,0) as zones, coalesce(round(cast(total as double),6),0) as total, list_aggregate(list_filter([case when coalesce(zones,0)=0 then 'no_zone' end, case when zones>1 then 'several_zones' end, case when total<whole-0.1 then 'gap' end, case when total>whole+0.1 then 'overlap' end, case when touch then 'contact' end], lambda x: x is not null),'string_agg',',') as warnings from square q left join z using (c_custkey)""")
def plan_analysis(spark, sf_dir):
    """Each parcel against the general plan: zones, total area, warnings."""
    p = parcels(spark, sf_dir)
    return C.each(p, P.SHAPED, lambda v: _analysed(v, zones(spark, sf_dir))).select("c_custkey", "zones", "total", "warnings")


def _analysed(p: DataFrame, z: DataFrame) -> DataFrame:
    m = P.meeting(p, z, CELL).groupBy(F.col(f"l_{C.SAME}").alias(C.SAME)).agg(F.count_if(~F.col("touches")).alias("zones"), F.sum("area").alias("total"), F.bool_or("touches").alias("touch"))
    d = p.withColumn("whole", G.measure("shape")["area"]).join(m, C.SAME, "left")
    n, t = F.coalesce("zones", F.lit(0)), F.coalesce("total", F.lit(0.0))
    warn = [F.when(n == 0, "no_zone"), F.when(n > 1, "several_zones"), F.when(F.col("total") < F.col("whole") - 0.1, "gap"), F.when(F.col("total") > F.col("whole") + 0.1, "overlap"), F.when(F.col("touch"), "contact")]
    text = F.concat_ws(",", *warn)
    return d.select(C.SAME, n.alias("zones"), F.round(t, 6).alias("total"), F.nullif(text, F.lit("")).alias("warnings"))


@query("select page_id, coalesce(len(regexp_extract_all(html,'(?i)<a\\b')),0) as n_links, coalesce(len(regexp_extract_all(html,'(?i)<p\\b')),0) as n_paragraphs, nullif(regexp_extract(html,'(?i)<html[^>]*\\blang=\"([^\"]*)\"',1),'') as lang from pages")
def page_records(spark, sf_dir):
    """Language and counts of links and paragraphs of pages."""
    from zonaris.functions.text import html_records

    return html_records(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.col("n_links").cast("bigint").alias("n_links"), F.col("n_paragraphs").cast("bigint").alias("n_paragraphs"), "lang")
