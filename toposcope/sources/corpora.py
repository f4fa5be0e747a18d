"""Annotated corpora as (identifier, text, gold), and checks on them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.sources.splits import latest, records

GOLD = "array<struct<start:int,end:int,name:string,latitude:double,longitude:double>>"
CORPUS = f"identifier string, text string, gold {GOLD}"


def _on_surface(text, spans):
    return F.filter(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["name"])


def geovirus(spark: SparkSession, path: str) -> DataFrame:
    """XML articles; locations count from 1 and misaligned ones are dropped."""
    schema = "source string, text string, locations struct<location:array<struct<name:string,start:int,end:int,lat:double,lon:double>>>"
    rows = spark.read.format("xml").option("rowTag", "article").schema(schema).load(path)
    spans = F.transform(F.coalesce("locations.location", F.array()), lambda s: F.struct((s["start"] - 1).alias("start"), (s["end"] - 1).alias("end"), s["name"].alias("name"), s["lat"].alias("latitude"), s["lon"].alias("longitude")))
    return rows.select(F.col("source").alias("identifier"), "text", _on_surface(F.col("text"), spans).alias("gold"))


def newsli(spark: SparkSession, path: str, limit: int = 500) -> DataFrame:
    """JSON object of article id to spans with LOC, lat, lon; the first `limit` ids in order.

    dropped: how many spans of an article were not on their surface.
    """
    raw = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<text:string,spans:array<struct<start:int,end:int,LOC:string,lat:double,lon:double>>>>"
    rows = raw.select(F.explode(F.from_json("value", kind)).alias("identifier", "a"))
    spans = F.transform("a.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["LOC"].alias("name"), s["lat"].alias("latitude"), s["lon"].alias("longitude")))
    rows = rows.select("identifier", F.col("a.text").alias("text"), spans.alias("all")).orderBy("identifier").limit(limit)
    kept = rows.withColumn("gold", _on_surface(F.col("text"), F.col("all")))
    return kept.select("identifier", "text", "gold", (F.coalesce(F.size("all"), F.lit(0)) - F.coalesce(F.size("gold"), F.lit(0))).alias("dropped"))


def hipe(spark: SparkSession, path: str, coordinates: DataFrame | None = None) -> DataFrame:
    """Token rows with BIO labels; texts are put together again, LOC spans get coordinates by QID.

    A file is read in splits; which document a line belongs to is carried over them, and
    offsets are running sums per document.
    """
    name = F.regexp_extract("line", r"^#\s*hipe2022:document_id\s*=\s*(\S+)", 1)
    lines = records(spark, path).withColumn("line", F.regexp_replace("value", "\r$", ""))
    named = latest(lines, F.when(name != "", name), "doc")
    own = named.where(~F.col("line").rlike("^#") & (F.col("line") != "") & ~F.col("line").rlike("^TOKEN\t") & F.col("doc").isNotNull())
    cell = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    place = F.struct("file", "split", "n").alias("n")
    tokens = own.select("doc", place, cell(0).alias("token"), cell(1).alias("label"), cell(7).alias("qid"), (~F.coalesce(cell(9), F.lit("")).contains("NoSpaceAfter")).alias("space"))
    d = Window.partitionBy("doc").orderBy("n")
    width = F.length("token") + F.col("space").cast("int")
    placed = tokens.withColumn("start", F.coalesce(F.sum(width).over(d.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("end", (F.col("start") + F.length("token")).cast("int"))
    begins = F.lower("label").rlike("^b-loc") | (F.lower("label").rlike("^i-loc") & ~F.coalesce(F.lower(F.lag("label").over(d)).rlike("^[bi]-loc"), F.lit(False)))
    island = placed.withColumn("island", F.sum(begins.cast("int")).over(d))
    spans = island.where(F.lower("label").rlike("^[bi]-loc")).groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("qid", "n").alias("qid"))
    pieces = F.array_sort(F.collect_list(F.struct("n", F.concat("token", F.when(F.col("space"), " ").otherwise("")).alias("t"))))
    text = placed.groupBy("doc").agg(F.rtrim(F.array_join(F.transform(pieces, lambda x: x["t"]), "")).alias("text"))
    if coordinates is not None:
        spans = spans.join((coordinates), "qid", "left")
    else:
        spans = spans.withColumn("latitude", F.lit(None).cast("double")).withColumn("longitude", F.lit(None).cast("double"))
    joined = spans.join(text, "doc").withColumn("name", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    gold = joined.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "name", "latitude", "longitude"))).cast(GOLD).alias("gold"))
    return text.join(gold, "doc", "left").select(F.col("doc").alias("identifier"), "text", F.coalesce("gold", F.array().cast(GOLD)).alias("gold"))


def wikiann(rows: DataFrame, location: tuple[int, int] = (5, 6)) -> DataFrame:
    """(id, tokens, ner_tags) to text and location spans; an inside tag without a beginning opens a span.

    orphans counts such tags.
    """
    begin, inside = location
    t = rows.select("id", F.posexplode(F.arrays_zip("tokens", "ner_tags")).alias("n", "x")).select("id", "n", F.col("x.tokens").alias("token"), F.col("x.ner_tags").alias("tag"))
    w = Window.partitionBy("id").orderBy("n")
    placed = t.withColumn("start", F.coalesce(F.sum(F.length("token") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("end", (F.col("start") + F.length("token")).cast("int"))
    orphan = (F.col("tag") == inside) & ~F.coalesce(F.lag("tag").over(w).isin(begin, inside), F.lit(False))
    marked = placed.withColumn("orphan", orphan).withColumn("island", F.sum(((F.col("tag") == begin) | F.col("orphan")).cast("int")).over(w))
    spans = marked.where(F.col("tag").isin(begin, inside)).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    orphans = marked.groupBy("id").agg(F.count_if("orphan").alias("orphans"))
    return rows.select("id", F.array_join("tokens", " ").alias("text")).join(orphans, "id", "left").join(spans, "id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Cached QID coordinates (JSON object of qid to [lat, lon] or null): nulls are known absences, and stay as such."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("qid", "c"))
    return raw.select("qid", F.get("c", F.lit(0)).alias("latitude"), F.get("c", F.lit(1)).alias("longitude"))


def to_ask(qids: DataFrame, cache: DataFrame, batch: int = 50) -> DataFrame:
    """(qid, batch): what the cache does not know yet, in batches of about that size; known absences are not asked again."""
    new = qids.select("qid").where("qid is not null").distinct().join(cache.select("qid"), "qid", "left_anti")
    n = new.count()
    return new.withColumn("batch", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-n // batch)))))


def first_coordinates(claims: DataFrame, asked: DataFrame) -> DataFrame:
    """What a cache takes up: the first coordinate claim of each asked qid, nulls where it has none.

    claims: (qid, pos, latitude, longitude) in the order of the source; asked: (qid).
    """
    first = claims.groupBy("qid").agg(F.min(F.struct("pos", "latitude", "longitude")).alias("c"))
    return asked.select("qid").distinct().join(first, "qid", "left").select("qid", "c.latitude", "c.longitude")


def digest(corpus: DataFrame) -> str:
    """A fingerprint of the rows of a corpus, whatever their order; repeated rows count."""
    row = F.to_json(F.struct(*sorted(corpus.columns)), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(row, F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    r = corpus.agg(F.count("*").alias("n"), *sums).first()
    return hashlib.sha256(":".join(map(str, r)).encode()).hexdigest()


def unique_records(rows: DataFrame, by: str) -> DataFrame:
    """Rows that are equal in all columns count once; removed and collapsed counts per group."""
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("__c"))
    return each.groupBy(by).agg(F.sum("__c").alias("records"), F.count("*").alias("kept"), F.sum(F.col("__c") - 1).alias("removed"), F.count_if(F.col("__c") > 1).alias("collapsed"))


def exploded(corpus: DataFrame) -> DataFrame:
    return corpus.select("identifier", "text", F.explode_outer("gold").alias("g")).select("identifier", "text", "g.*")


def overlaps(spans: DataFrame, key: str = "identifier") -> DataFrame:
    """Spans that begin before an earlier span of the document has ended."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max("end").over(w)).where(F.col("start") < F.col("reached"))


def problems(corpus: DataFrame) -> DataFrame:
    """(identifier, problem, n): what a corpus breaks."""
    spans = exploded(corpus)
    real = spans.where("start is not null")

    def found(rows: DataFrame, what: str) -> DataFrame:
        return rows.groupBy("identifier").agg(F.count("*").alias("n")).select("identifier", F.lit(what).alias("problem"), "n")

    parts = [
        found(real.where("start < 0 or start >= end or end > length(text)"), "offset"),
        found(real.where("start >= 0 and start < end and substring(text, start + 1, end - start) <> name"), "surface"),
        found(real.where("abs(latitude) > 90 or abs(longitude) > 180 or (latitude is null) <> (longitude is null)"), "coordinate"),
        found(real.groupBy("identifier", "start", "end").count().where("count > 1"), "duplicate span"),
        found(overlaps(real.dropDuplicates(["identifier", "start", "end"])), "overlapping span"),
        found(spans.where("start is null"), "missing gold"),
        found(corpus.groupBy("identifier").count().where("count > 1"), "duplicate document"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

