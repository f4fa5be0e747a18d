"""Registered queries and their SQL.

The test tables hold no gazetteer, so parts, customers and nations stand for places, order
lines for spans, and events and conversations for runs and annotation sessions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.functions import context, geo, text
from toposcope.operators import annotate, build, evaluate, facade, project, resolve, store, tagger
from toposcope.operators.scratch import folder
from toposcope.operators.search import ALL, Search
from toposcope.plans.blocks import ROW, BlockPlan
from toposcope.plans.config import Block
from toposcope.sources import corpora, sinks

FLAGSHIP = "search_partial_tiers"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _block(spark: SparkSession, sf_dir: str, block: Block, row: str, others: tuple[str, ...] = ()) -> BlockPlan:
    _table(spark, sf_dir, block.source).withColumn(ROW, F.col(row)).createOrReplaceTempView(block.source)
    for name in others:
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    return BlockPlan(spark, block)


# -- build ---------------------------------------------------------------------------------


BRANDS = Block("part", "p_brand", ["p_name"], ["p_name", "CASE WHEN p_size > 25 THEN p_size END AS size", "upper(p_type) AS kind"])


@query("""SELECT p_brand AS identifier, 'part' AS source,
    CAST(to_json({'p_name': arg_min(p_name, p_partkey), 'size': arg_min(CASE WHEN p_size > 25 THEN p_size END, p_partkey), 'kind': arg_min(upper(p_type), p_partkey)}) AS VARCHAR) AS data
    FROM part WHERE p_brand IS NOT NULL GROUP BY 1""")
def build_features_first_row(spark, sf_dir):
    return _block(spark, sf_dir, BRANDS, "p_partkey").features().drop("geometry")


@query("""SELECT DISTINCT p_brand AS identifier, trim(part) AS text FROM (
    SELECT p_brand, unnest(string_split(p_name, ' ')) AS part FROM part UNION ALL SELECT p_brand, p_type FROM part) WHERE trim(part) <> ''""")
def build_names_explode(spark, sf_dir):
    return _block(spark, sf_dir, Block("part", "p_brand", ["explode(split(p_name, ' '))", "p_type"]), "p_partkey").names()


@query("""SELECT CAST(c_custkey AS VARCHAR) AS identifier,
    CAST(to_json({'c_name': c_name, 'nation': n.n_name, 'region': r.r_name}) AS VARCHAR) AS data
    FROM customer LEFT JOIN nation n ON c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def left_join_chain(spark, sf_dir):
    joins = ["LEFT JOIN nation n ON c_nationkey = n.n_nationkey", "LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"]
    b = Block("customer", "c_custkey", ["c_name"], ["c_name", "n.n_name AS nation", "r.r_name AS region"], joins)
    return _block(spark, sf_dir, b, "c_custkey", ("nation", "region")).features().select("identifier", "data")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS identifier, CAST(to_json({'region': r.r_name}) AS VARCHAR) AS data
    FROM nation LEFT JOIN region r ON 'R' || '.' || n_regionkey = 'R' || '.' || r.r_regionkey""")
def left_join_concat_key(spark, sf_dir):
    b = Block("nation", "n_nationkey", ["n_name"], ["r.r_name AS region"], ["LEFT JOIN region r ON 'R' || '.' || n_regionkey = 'R' || '.' || r.r_regionkey"])
    return _block(spark, sf_dir, b, "n_nationkey", ("region",)).features().select("identifier", "data")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS identifier, CAST(to_json({'nation': n.n_name}) AS VARCHAR) AS data
    FROM customer LEFT JOIN nation n ON regexp_extract(c_name, '[0-9]+$') LIKE '%' || n.n_nationkey AND c_nationkey = n.n_nationkey""")
def left_join_regex_key(spark, sf_dir):
    b = Block("customer", "c_custkey", ["c_name"], ["n.n_name AS nation"], ["LEFT JOIN nation n ON regexp_extract(c_name, '[0-9]+$', 0) LIKE '%' || n.n_nationkey AND c_nationkey = n.n_nationkey"])
    return _block(spark, sf_dir, b, "c_custkey", ("nation",)).features().select("identifier", "data")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS identifier, CAST(to_json({'o_orderstatus': o_orderstatus}) AS VARCHAR) AS data
    FROM orders WHERE o_orderstatus = 'F'""")
def null_identifier_filter(spark, sf_dir):
    b = Block("orders", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END", ["o_orderstatus"], ["o_orderstatus"])
    return _block(spark, sf_dir, b, "o_orderkey").features().select("identifier", "data")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS identifier, count(DISTINCT (l_linenumber, l_suppkey)) AS n FROM lineitem SEMI JOIN
    (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) USING (l_orderkey) GROUP BY 1""")
def dup_semi_join(spark, sf_dir):
    geo.register(spark)
    b = Block("lineitem", "l_orderkey", ["l_linestatus"], geometry="ST_Point(CAST(l_linenumber AS DOUBLE), CAST(l_suppkey AS DOUBLE))")
    merged = _block(spark, sf_dir, b, "l_orderkey").merged_geometries()
    many = F.from_json(geo.geojson_geometry("geometry"), "struct<type:string,coordinates:array<array<double>>>")
    return merged.select("identifier", F.when(many["type"] == "Point", 1).otherwise(F.size(many["coordinates"])).cast("long").alias("n"))


@query("""SELECT identifier, count(*) AS n, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM (
    SELECT CAST(s_suppkey AS VARCHAR) AS identifier, 'supplier' AS source FROM supplier UNION ALL
    SELECT CAST(n_nationkey AS VARCHAR), 'nation' FROM nation) GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5""")
def cross_block_check(spark, sf_dir):
    one = lambda name, key: _table(spark, sf_dir, name).select(F.col(key).cast("string").alias("identifier"), F.lit(name).alias("source"))
    return build.duplicate_identifiers(one("supplier", "s_suppkey").unionByName(one("nation", "n_nationkey")))


def _places(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Features and names of the parts, one of each."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("identifier"), "p_name")
    feature = build.dense_ids(rows, [F.col("identifier")], "id")
    return feature, build.link_names(rows.select("identifier", F.trim("p_name").alias("text")), feature)


_FEATURE_SQL = "feature AS (SELECT CAST(p_partkey AS VARCHAR) AS identifier, trim(p_name) AS text, row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) AS id FROM part)"


@query(f"WITH {_FEATURE_SQL} SELECT id, identifier FROM feature")
def feature_ids(spark, sf_dir):
    return _places(spark, sf_dir)[0].select("id", "identifier")


@query("""WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS fid FROM (SELECT DISTINCT p_brand FROM part))
    SELECT row_number() OVER (ORDER BY fid, text) AS id, fid AS feature_id, text FROM (SELECT DISTINCT fid, trim(p_name) AS text FROM part JOIN f USING (p_brand))""")
def link_names(spark, sf_dir):
    plan = _block(spark, sf_dir, BRANDS, "p_partkey")
    return build.link_names(plan.names(), build.number_features(plan.features()))


@query("""SELECT c_custkey, coalesce((SELECT string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS priorities FROM customer""")
def correlated_listagg(spark, sf_dir):
    # the aggregate comes first, so that the join is one to one
    lists = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("p"))
    return _table(spark, sf_dir, "customer").select("c_custkey").join(lists, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit("")).alias("priorities"))


_PUBLISHED: dict[tuple[str, str, str], store.Gazetteer] = {}


def _published(spark, sf_dir, name: str, tables) -> store.Gazetteer:
    """A store of the given tables, built and published once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PUBLISHED:
        _PUBLISHED[key] = store.Gazetteer(spark, store.write(spark, folder(spark, "gazetteers"), name, tables()))
    return _PUBLISHED[key]


def _brands(spark, sf_dir) -> store.Gazetteer:
    def tables():
        plan = _block(spark, sf_dir, BRANDS, "p_partkey")
        feature = build.number_features(plan.features())
        return {"feature": feature, "name": build.link_names(plan.names(), feature)}

    return _published(spark, sf_dir, "brands", tables)


@query("SELECT p_brand AS identifier, arg_min(p_name, p_partkey) AS first_name, CAST(arg_min(CASE WHEN p_size > 25 THEN p_size END, p_partkey) FILTER (WHERE p_size > 25) AS VARCHAR) AS size FROM part WHERE p_brand = 'Brand#11' GROUP BY 1")
def find_identifier(spark, sf_dir):
    g = _brands(spark, sf_dir)
    return g.find("Brand#11").select("identifier", g.data_value("p_name").alias("first_name"), g.data_value("size").alias("size"))


@query("""WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS fid FROM (SELECT DISTINCT p_brand FROM part))
    SELECT id, fid AS feature_id, text FROM (SELECT row_number() OVER (ORDER BY fid, text) AS id, fid, text FROM (SELECT DISTINCT fid, trim(p_name) AS text FROM part JOIN f USING (p_brand))) WHERE fid = 3""")
def names_of_feature(spark, sf_dir):
    return _brands(spark, sf_dir).names_of(3)


@query("""SELECT 'feature' AS tab, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'name', count(*) FROM (SELECT DISTINCT p_brand, trim(p_name) FROM part)""")
def store_counts(spark, sf_dir):
    m = _brands(spark, sf_dir).metadata
    return spark.createDataFrame([("feature", int(m["feature_count"])), ("name", int(m["name_count"]))], "tab string, n long")


# -- search --------------------------------------------------------------------------------


def _search(spark, sf_dir) -> tuple[Search, DataFrame]:
    def tables():
        feature, name = _places(spark, sf_dir)
        return {"feature": feature, "name": name}

    return Search.of(_published(spark, sf_dir, "parts", tables)), _table(spark, sf_dir, "part")


def rebuilt_search(spark, sf_dir) -> Search:
    """The store of the parts built and published anew."""
    _PUBLISHED.pop((spark.sparkContext.applicationId, sf_dir, "parts"), None)
    return _search(spark, sf_dir)[0]


def _words_sql(words: str) -> str:
    """BM25 over phrases (qid, phrase, toks) of the relation `words`."""
    return f"""WITH {_FEATURE_SQL},
    doc AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9.]+'), lambda x: x <> '') AS t FROM feature),
    q AS (SELECT DISTINCT trim(p_name) AS query_id FROM part), {words},
    hit AS (SELECT w.query_id, w.phrase, d.id, len(d.t) AS dl,
        len(list_filter(range(1, len(d.t) - len(w.toks) + 2), lambda i: list_slice(d.t, i, i + len(w.toks) - 1) = w.toks)) AS f FROM words w JOIN doc d ON list_has_all(d.t, w.toks)),
    n AS (SELECT query_id, phrase, count(*) AS n FROM hit WHERE f > 0 GROUP BY 1, 2),
    total AS (SELECT count(*) AS rows_all, avg(len(t)) AS mean FROM doc),
    s AS (SELECT query_id, id AS feature_id, round(sum(-CASE WHEN ln((rows_all - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows_all - n + 0.5) / (n + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 12) AS score
        FROM hit JOIN n USING (query_id, phrase), total WHERE f > 0 GROUP BY 1, 2)"""


_TIERS_SQL = """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, feature_id) AS position FROM s)
    SELECT query_id, feature_id, tier, position FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY score) AS tier FROM top WHERE position <= {limit}) WHERE tier <= {tiers}"""


def _name_queries(part: DataFrame) -> DataFrame:
    return part.select(F.trim("p_name").alias("text")).distinct().withColumn("query_id", F.col("text"))


@query(f"WITH {_FEATURE_SQL}, q AS (SELECT DISTINCT trim(p_name) AS query_id FROM part) SELECT query_id, id AS feature_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS position FROM q JOIN feature ON lower(text) = lower(query_id) QUALIFY position <= 40")
def search_exact_batch(spark, sf_dir):
    index, part = _search(spark, sf_dir)
    return index.exact(_name_queries(part), limit=40)


@query(_words_sql("words AS (SELECT query_id, 0 AS phrase, string_split(lower(query_id), ' ') AS toks FROM q)") + _TIERS_SQL.format(limit=10000, tiers=1))
def search_phrase_tiers(spark, sf_dir):
    index, part = _search(spark, sf_dir)
    return index.phrase(_name_queries(part)).drop("score")


@query(_words_sql("words AS (SELECT query_id, unnest(range(len(string_split(query_id, ' ')))) AS phrase, [unnest(string_split(lower(query_id), ' '))] AS toks FROM q)") + _TIERS_SQL.format(limit=500, tiers=2))
def search_partial_tiers(spark, sf_dir):
    index, part = _search(spark, sf_dir)
    return index.partial(_name_queries(part), limit=500, tiers=2).drop("score")


def _soundex_sql(x: str) -> str:
    letters = f"regexp_replace(upper({x}), '[^A-Z]', '', 'g')"
    digits = f"translate(substr({letters}, 1, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g'), 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000000111122222222334556')"
    for d in "0123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE substr({letters}, 1, 1) || substr(replace(substr({digits}, 2), '0', '') || '000', 1, 3) END"


@query(f"""WITH {_FEATURE_SQL}, q AS (SELECT DISTINCT replace(trim(p_name), 'i', 'e') AS query_id FROM part),
    s AS (SELECT query_id, id AS feature_id, levenshtein(lower(query_id), lower(text)) AS score FROM q JOIN feature ON {_soundex_sql("query_id")} = {_soundex_sql("text")})""" + _TIERS_SQL.format(limit=10000, tiers=1))
def search_fuzzy_tiers(spark, sf_dir):
    index, part = _search(spark, sf_dir)
    q = part.select(F.replace(F.trim("p_name"), F.lit("i"), F.lit("e")).alias("text")).distinct().withColumn("query_id", F.col("text"))
    return index.fuzzy(q).drop("score")


@query(f"SELECT DISTINCT x, {_soundex_sql('x')} AS code FROM (SELECT p_name AS x FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part UNION SELECT c_name FROM customer)")
def soundex_names(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("x")).union(p.select("p_type")).union(p.select("p_brand")).union(_table(spark, sf_dir, "customer").select("c_name"))
    return names.distinct().withColumn("code", text.soundex(F.col("x")))


@query("SELECT p_partkey, levenshtein(trim(regexp_replace(lower(p_name), '[^a-z0-9]', ' ', 'g')), trim(regexp_replace(lower(p_type), '[^a-z0-9]', ' ', 'g'))) AS d FROM part")
def levenshtein_norm(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.edit_distance(F.col("p_name"), F.col("p_type")).cast("long").alias("d"))


@query(f"SELECT p_partkey, {_soundex_sql('p_name')} AS code, levenshtein(trim(regexp_replace(lower(p_name), '[^a-z0-9]', ' ', 'g')), trim(regexp_replace(lower(p_type), '[^a-z0-9]', ' ', 'g'))) AS d FROM part WHERE {_soundex_sql('p_name')} = {_soundex_sql('p_type')} OR p_size > 5")
def sql_functions(spark, sf_dir):
    """The functions that users have in their own SQL."""
    text.register(spark)
    _table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, name_soundex(p_name) AS code, CAST(edit_distance_ci(p_name, p_type) AS BIGINT) AS d FROM part WHERE name_soundex(p_name) = name_soundex(p_type) OR p_size > 5")


# -- pipeline tables -----------------------------------------------------------------------


def _spans(spark, sf_dir) -> DataFrame:
    """Spans over documents, from order lines."""
    start = (F.col("l_linenumber") * 4 + F.col("l_partkey") % 5).cast("int")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), start.alias("start"), (start + 1 + F.col("l_suppkey") % 6).cast("int").alias("end"), (F.col("l_partkey") % 4).alias("kind"))


_SPANS = "spans AS (SELECT l_orderkey AS document_id, l_orderkey * 10 + l_linenumber AS id, CAST(l_linenumber * 4 + l_partkey % 5 AS INTEGER) AS start, CAST(l_linenumber * 4 + l_partkey % 5 + 1 + l_suppkey % 6 AS INTEGER) AS \"end\", l_partkey % 4 AS kind FROM lineitem)"


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    marks = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit("m").alias("recognizer_id"))
    return project.unprocessed(docs, marks, "document_id", "recognizer_id", "m")


@query(f"WITH {_SPANS} SELECT id FROM spans JOIN orders ON document_id = o_orderkey WHERE id NOT IN (SELECT id FROM spans WHERE kind = 2)")
def unprocessed_references(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    own = spans.join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")), "document_id").select("id")
    return project.unprocessed(own, spans.where("kind = 2").select(F.col("id").alias("reference_id"), F.lit("m").alias("resolver_id")), "reference_id", "resolver_id", "m")


@query(f"WITH {_SPANS} SELECT s.document_id, s.id, s.start, s.\"end\", r.id AS feature_identifier FROM spans s LEFT JOIN (SELECT id FROM spans WHERE kind = 3 AND id % 2 = 0) r ON s.id = r.id WHERE s.kind IN (1, 3) AND s.document_id % 3 = 0")
def tag_view(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    refs = spans.withColumn("recognizer_id", F.when(F.col("kind").isin(1, 3), "odd").otherwise("even")).withColumn("text", F.lit(""))
    links = spans.where("kind = 3 and id % 2 = 0").select(F.col("id").alias("reference_id"), F.lit("best").alias("resolver_id"), F.lit("g").alias("gazetteer_name"), F.col("id").alias("feature_identifier"))
    docs = spans.select(F.col("document_id").alias("id")).distinct().withColumn("project_id", F.concat(F.lit("p"), F.col("id") % 3))
    tags = spark.range(1).select(F.lit("p0").alias("project_id"), F.lit("latest").alias("tag"), F.lit("odd").alias("recognizer_id"), F.lit("best").alias("resolver_id"))
    return project.tag_view(refs, links, docs, tags, "latest").drop("text", "gazetteer_name")


@query("SELECT doc_id, p AS start, p + 6 AS \"end\", substr(text, p + 1, 6) AS surface FROM (SELECT doc_id, text, CAST(unnest(range(0, length(text), 97)) AS INTEGER) AS p FROM documents) WHERE p + 6 <= length(text)")
def span_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("length(text) > 0")
    spans = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(97))).alias("start")).withColumn("end", F.col("start") + 6)
    return spans.where("end <= length(text)").select("doc_id", "start", "end", text.span_text(F.col("text"), F.col("start"), F.col("end")).alias("surface"))


@query(f"WITH {_SPANS} SELECT a.document_id, a.id, b.id AS other_id FROM spans a JOIN spans b ON a.document_id = b.document_id AND a.start < b.\"end\" AND a.\"end\" > b.start AND a.id < b.id")
def span_overlaps(spark, sf_dir):
    return annotate.overlapping(_spans(spark, sf_dir))


@query(f"WITH {_SPANS}, d AS (SELECT DISTINCT document_id, start, \"end\" FROM spans) SELECT * FROM (SELECT document_id, start, \"end\", max(\"end\") OVER (PARTITION BY document_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM d) WHERE start < reached")
def overlap_running_max(spark, sf_dir):
    return corpora.overlaps(_spans(spark, sf_dir).select("document_id", "start", "end").distinct(), "document_id")


@query(f"WITH {_SPANS} SELECT DISTINCT document_id, start, \"end\" FROM spans a WHERE kind < 2 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.kind >= 2 AND b.document_id = a.document_id AND b.start = a.start AND b.\"end\" = a.\"end\")")
def dedupe_spans(spark, sf_dir):
    spans = _spans(spark, sf_dir).select("document_id", "start", "end", "kind")
    return annotate.new_spans(spans.where("kind < 2").drop("kind"), spans.where("kind >= 2").drop("kind"))


@query(f"WITH {_SPANS}, d AS (SELECT DISTINCT document_id, start, \"end\" FROM spans) SELECT * FROM (SELECT document_id, start, \"end\", lag(\"end\") OVER (PARTITION BY document_id ORDER BY start, \"end\") AS before FROM d) WHERE start < before")
def adjacent_overlap(spark, sf_dir):
    from toposcope.operators.recognize import adjacent_overlaps

    return adjacent_overlaps(_spans(spark, sf_dir).select("document_id", "start", "end").distinct())


@query("""SELECT conv_id AS document_id, count(*) FILTER (WHERE role IS NOT NULL) AS total, count(*) FILTER (WHERE length(text) % 3 > 0) AS annotated,
    CASE WHEN count(*) = 0 THEN 0.0 ELSE 100.0 * count(*) FILTER (WHERE length(text) % 3 > 0) / count(*) END AS "percent" FROM conversations GROUP BY 1""")
def progress(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    toponyms = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("id"), F.when(F.length("text") % 3 == 0, "").when(F.length("text") % 3 == 1, "x").alias("loc_id"))
    return annotate.progress(c.select(F.col("conv_id").alias("id")).distinct(), toponyms)


@query("""WITH t AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'e' || event_id % 5 END AS loc_id FROM events),
    a AS (SELECT user_id, event_type, max('e' || event_id % 5) AS chosen FROM events WHERE event_id % 7 = 0 GROUP BY 1, 2)
    SELECT event_id, CASE WHEN loc_id = '' AND chosen IS NOT NULL THEN chosen ELSE loc_id END AS loc_id FROM t LEFT JOIN a USING (user_id, event_type)""")
def one_sense_propagation(spark, sf_dir):
    loc = F.concat(F.lit("e"), F.col("event_id") % 5)
    e = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id"), F.col("event_type").alias("text"), loc.alias("loc_id"))
    rows = e.withColumn("loc_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("loc_id")))
    return annotate.propagate(rows, e.where("event_id % 7 = 0")).select("event_id", "loc_id")


@query("SELECT conv_id AS session_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS doc_index FROM conversations WHERE turn % 3 <> 1")
def reindex(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").where("turn % 3 <> 1")
    return annotate.reindex(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("turn").alias("doc_index"))).withColumn("doc_index", F.col("doc_index").cast("long"))


# -- evaluation ----------------------------------------------------------------------------


@query(f"""WITH {_SPANS}, g AS (SELECT DISTINCT document_id, start, "end" FROM spans WHERE kind < 3), p AS (SELECT DISTINCT document_id, start, "end" FROM spans WHERE kind > 0 AND id % 5 > 0),
    c AS (SELECT (SELECT count(*) FROM g JOIN p USING (document_id, start, "end")) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (document_id, start, "end")) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (document_id, start, "end")) AS fn)
    SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def span_prf(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    out = evaluate.with_prf(evaluate.span_counts(spans.where("kind < 3"), spans.where("kind > 0 and id % 5 > 0")))
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _counts(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    n = lambda c: F.count_if(c).alias
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return rows.groupBy("lang").agg(n(q & ~t)("tp"), n(q & t)("fp"), n(~q)("fn"))


@query("""WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality <> 1) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    m AS (SELECT 'macro' AS average, lang, tp, fp, fn FROM c UNION ALL SELECT 'micro', NULL, sum(tp), sum(fp), sum(fn) FROM c),
    r AS (SELECT average, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM m)
    SELECT average, round(avg(p), 9) AS "precision", round(avg(r), 9) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9) AS f1 FROM r GROUP BY 1""")
def macro_micro(spark, sf_dir):
    return evaluate.macro_micro(_counts(spark, sf_dir)).select("average", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_SPANS}, g AS (SELECT DISTINCT document_id, start, "end", kind FROM spans), p AS (SELECT DISTINCT document_id, start, "end", kind FROM spans WHERE id % 3 > 0)
    SELECT count(*) AS n, count(p.document_id) AS correct, round(count(p.document_id) / count(*), 9) AS accuracy FROM g LEFT JOIN p USING (document_id, start, "end", kind)""")
def resolution_accuracy(spark, sf_dir):
    spans = _spans(spark, sf_dir).withColumn("identifier", F.col("kind").cast("string"))
    return evaluate.resolution_accuracy(spans, spans.where("id % 3 > 0")).withColumn("accuracy", F.round("accuracy", 9))


def _located(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(key.alias("document_id"), F.lit(0).alias("start"), F.lit(5).alias("end"), (key * 37 % 170 - 85).cast("double").alias("latitude"), (key * 91 % 350 - 175).cast("double").alias("longitude"), "c_nationkey")
    guess = rows.where("document_id % 4 > 0").withColumn("latitude", F.col("latitude") + F.col("c_nationkey") / 8).withColumn("longitude", F.col("longitude") - F.col("c_nationkey") / 16)
    return rows, guess


_ERRORS = """e AS (SELECT c_custkey AS document_id, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 20039.0 ELSE 2 * 6371.0088 * asin(sqrt(least(1.0,
    pow(sin(radians(c_nationkey / 8) / 2), 2) + cos(radians(c_custkey * 37 % 170 - 85)) * cos(radians(c_custkey * 37 % 170 - 85 + c_nationkey / 8)) * pow(sin(radians(-c_nationkey / 16) / 2), 2)))) END AS km FROM customer)"""


@query(f"WITH {_ERRORS} SELECT document_id, round(km, 6) AS km FROM e")
def distance_errors(spark, sf_dir):
    return evaluate.distance_errors(*_located(spark, sf_dir)).select("document_id", F.round("km", 6).alias("km"))


@query(f"""WITH {_ERRORS} SELECT c_nationkey, count(*) AS n, round(avg(CASE WHEN km <= 161 THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(km), 6) AS mean_km,
    round(median(km), 6) AS median_km, round(avg(ln(1 + least(km, 20039.0)) / ln(20040.0)), 9) AS auc FROM e GROUP BY 1""")
def distance_metrics(spark, sf_dir):
    gold, guess = _located(spark, sf_dir)
    errors = evaluate.distance_errors(gold, guess).join(gold.select("document_id", "c_nationkey"), "document_id")
    out = evaluate.distance_metrics(errors, by=["c_nationkey"])
    return out.select("c_nationkey", "n", F.round("accuracy", 9).alias("accuracy"), F.round("mean_km", 6).alias("mean_km"), F.round("median_km", 6).alias("median_km"), F.round("auc", 9).alias("auc"))


@query()
def bootstrap_interval(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    counts = evaluate.span_counts(spans.where("kind < 3"), spans.where("kind > 0 and id % 5 > 0"), ["document_id"])
    return evaluate.interval(evaluate.bootstrap(counts, seed=1))


@query("SELECT event_type AS corpus, user_id AS pipeline, event_id AS run_id FROM events WHERE event_id % 4 > 0 AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    runs = e.select(F.col("event_type").alias("corpus"), F.col("user_id").alias("pipeline"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), (F.col("event_id") % 4 > 0).alias("complete"), F.col("value").alias("metric"))
    return evaluate.latest_runs(runs).select("corpus", "pipeline", "run_id")


@query("""SELECT b.event_type AS benchmark, round(b.m, 9) AS base, round(n.m, 9) AS new, n.m > 1.25 * b.m AS failed FROM
    (SELECT event_type, median(abs(value)) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1) b JOIN (SELECT event_type, median(abs(value) * (1 + user_id % 3)) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1) n USING (event_type)""")
def regression_gate(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("benchmark"), F.abs("value").alias("seconds"), "event_id", "user_id")
    out = evaluate.regressions(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("seconds", F.col("seconds") * (1 + F.col("user_id") % 3)))
    return out.select("benchmark", F.round("base", 9).alias("base"), F.round("new", 9).alias("new"), "failed")


@query("SELECT o_orderstatus AS status, count(*) AS count FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return evaluate.status_counts(_table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


@query(f"""WITH {_SPANS}, r AS (SELECT kind, start % 8 AS s, "end" % 8 AS e, count(*) AS c FROM spans GROUP BY 1, 2, 3)
    SELECT kind, CAST(sum(c) AS BIGINT) AS records, count(*) AS kept, CAST(sum(c - 1) AS BIGINT) AS removed, count(*) FILTER (WHERE c > 1) AS collapsed FROM r GROUP BY 1""")
def unique_records(spark, sf_dir):
    return corpora.unique_records(_spans(spark, sf_dir).select("kind", (F.col("start") % 8).alias("s"), (F.col("end") % 8).alias("e")), "kind")


# -- ranking and scalar functions ----------------------------------------------------------


_DOT = "list_sum(list_transform(list_zip(e.embedding, f.embedding), lambda x: x[1]::DOUBLE * x[2]))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x)))"


@query(f"""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS embedding, min(vec_id) AS id FROM embeddings GROUP BY 1)
    SELECT e.vec_id, e.label, round({_DOT} / ({_NORM.format("e")} * {_NORM.format("f")}), 6) AS similarity FROM embeddings e JOIN f USING (label)""")
def cosine_to_first(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", "label", F.round(text.cosine(F.col("embedding"), F.col("first")), 6).alias("similarity"))


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS position, l_partkey AS feature_id, l_quantity AS score FROM lineitem)
    SELECT id, position, feature_id FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, position, feature_id) = 1""")
def argmax_first(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("feature_id"), F.col("l_quantity").alias("score"))
    return resolve.best_candidate(rows).select("id", "position", "feature_id")


@query("""SELECT l_orderkey AS id, l_linenumber AS position FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) <= 2""")
def shortlist_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("feature_id"), F.col("l_extendedprice").alias("similarity"))
    return resolve.shortlist(rows, 2).select("id", "position")


@query("SELECT c_custkey, round(0.5 + 0.3 * CASE WHEN c_acctbal > 0 THEN log10(1 + c_acctbal) / 10 ELSE 0 END, 9) AS score FROM customer")
def prior_score(spark, sf_dir):
    prior = text.population_prior(F.col("c_acctbal").cast("string"))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(text.combined_score(F.lit(0.5), prior, 0.3), 9).alias("score"))


@query("""SELECT DISTINCT w, k, substr(w, 1, length(w) - k) AS variant FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part), (SELECT unnest([1, 2, 3]) AS k) WHERE length(w) - k >= 3""")
def inflection_variants(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return words.select("w", F.explode(text.inflections(F.col("w"))).alias("variant")).withColumn("k", (F.length("w") - F.length("variant")).cast("int"))


@query("SELECT c_custkey, c_name || CASE WHEN c_mktsegment <> '' THEN ' (' || c_mktsegment || ')' ELSE '' END || ' in ' || n_name || ', ' || r_name AS description FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def describe_features(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("c_custkey", text.describe(F.col("c_name"), F.col("c_mktsegment"), F.lit(None).cast("string"), F.col("n_name"), F.col("r_name")).alias("description"))


_X, _Y = "(c_custkey * 37 % 1000) / 10.0", "(c_custkey * 91 % 1000) / 10.0"
_SQUARES = "(n_nationkey % 5) * 20 AS x0, (n_nationkey // 5) * 20 AS y0"


def _squares(spark, sf_dir) -> DataFrame:
    n = _table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 5 * 20).cast("double").alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 20).cast("double").alias("y0"))
    return n.select("n_nationkey", _square("x0", "y0").alias("geometry"))


@query(f"""SELECT c_custkey, n_nationkey FROM customer JOIN (SELECT n_nationkey, {_SQUARES} FROM nation) ON {_X} >= x0 AND {_X} < x0 + 15 AND {_Y} >= y0 AND {_Y} < y0 + 15""")
def spatial_join(spark, sf_dir):
    # a point on a left or lower border is inside, so that of adjoining areas one has it
    points = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 1000 / 10.0).alias("x"), (F.col("c_custkey") * 91 % 1000 / 10.0).alias("y"))
    return geo.spatial_join(points, _squares(spark, sf_dir)).select("c_custkey", "n_nationkey")


def _block_with_areas(spark, sf_dir, predicate: str) -> DataFrame:
    geo.register(spark)
    point = geo.st_point(F.col("c_custkey") * 37 % 1000 / 10.0, F.col("c_custkey") * 91 % 1000 / 10.0)
    _table(spark, sf_dir, "customer").withColumn("geometry", point).withColumn(ROW, F.col("c_custkey")).createOrReplaceTempView("located_customer")
    _squares(spark, sf_dir).createOrReplaceTempView("square")
    _table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    joins = [f"LEFT JOIN square g ON {predicate}", "LEFT JOIN nation k ON g.n_nationkey = k.n_nationkey"]
    b = Block("located_customer", "c_custkey", ["c_name"], ["g.n_nationkey AS area", "k.n_name AS name"], joins)
    value = store.Gazetteer.data_value
    return BlockPlan(spark, b).features().select("identifier", value("area").alias("area"), value("name").alias("name"))


_IN_AREA = "SELECT CAST(c_custkey AS VARCHAR) AS identifier, CAST(min(n_nationkey) AS VARCHAR) AS area, arg_min(n_name, n_nationkey) AS name FROM customer LEFT JOIN (SELECT n_nationkey, n_name, {squares} FROM nation) ON {x} {gt} x0 AND {x} {lt} x0 + 15 AND {y} {gt} y0 AND {y} {lt} y0 + 15 GROUP BY 1"


@query(_IN_AREA.format(squares=_SQUARES, x=_X, y=_Y, gt=">", lt="<"))
def block_spatial_within(spark, sf_dir):
    return _block_with_areas(spark, sf_dir, "ST_Within(ST_Centroid(geometry), g.geometry)")


@query(_IN_AREA.format(squares=_SQUARES, x=_X, y=_Y, gt=">=", lt="<="))
def block_spatial_intersects(spark, sf_dir):
    return _block_with_areas(spark, sf_dir, "ST_Intersects(g.geometry, geometry)")


def _rectangle(x, y, width, height):
    @F.pandas_udf(T.BinaryType())
    def make(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        ring = lambda u, v, w, h: [(u, v), (u + w, v), (u + w, v + h), (u, v + h), (u, v)]
        return pd.Series([geo.write_wkb(geo.POLYGON, [ring(*r)]) for r in zip(a, b, c, d, strict=True)], dtype=object)

    return make(*[v.cast("double") for v in (x, y, width, height)])


def _square(x: str, y: str):
    return _rectangle(F.col(x), F.col(y), F.lit(15), F.lit(15))


# a third of the parts' rectangles are small, some are larger than everything else together
_PART_BOX = "p_partkey * 37 % 1009 AS x0, p_partkey * 91 % 1013 AS y0, pow(2, p_partkey % 13) AS w, pow(3, p_partkey % 7) AS h"
_SUPPLIER_BOX = "s_suppkey * 17 % 1009 AS x0, s_suppkey * 53 % 1013 AS y0, 1 + s_suppkey % 20 AS w, 1 + s_suppkey % 30 AS h"


@query(f"""SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, {_PART_BOX} FROM part) p JOIN (SELECT s_suppkey, {_SUPPLIER_BOX} FROM supplier) s
    ON p.x0 <= s.x0 + s.w AND s.x0 <= p.x0 + p.w AND p.y0 <= s.y0 + s.h AND s.y0 <= p.y0 + p.h""")
def spatial_join_extents(spark, sf_dir):
    shape = _rectangle(F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))
    left = _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey * 37 % 1009 AS x0", "p_partkey * 91 % 1013 AS y0", "pow(2, p_partkey % 13) AS w", "pow(3, p_partkey % 7) AS h")
    right = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_suppkey * 17 % 1009 AS x0", "s_suppkey * 53 % 1013 AS y0", "1 + s_suppkey % 20 AS w", "1 + s_suppkey % 30 AS h")
    return geo.geometry_join(left.select("p_partkey", shape.alias("shape")), right.select("s_suppkey", shape.alias("other")), "intersects").select("p_partkey", "s_suppkey")


@query("""WITH b AS (SELECT c_nationkey, c_custkey * 37 % 211 AS x0, c_custkey * 91 % 223 AS y0, 1 + c_custkey % 31 AS w, 1 + c_custkey % 17 AS h FROM customer),
    edges AS (SELECT DISTINCT c_nationkey, unnest([x0, x0 + w]) AS x FROM b),
    strips AS (SELECT c_nationkey, x, lead(x) OVER (PARTITION BY c_nationkey ORDER BY x) AS x2 FROM edges),
    pieces AS (SELECT s.c_nationkey, x, x2, y0, y0 + h AS y1 FROM strips s JOIN b ON b.c_nationkey = s.c_nationkey AND b.x0 <= s.x AND s.x2 <= b.x0 + b.w),
    covered AS (SELECT *, max(y1) OVER (PARTITION BY c_nationkey, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pieces)
    SELECT c_nationkey, CAST(sum((x2 - x) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) AS BIGINT) AS area FROM covered GROUP BY c_nationkey""")
def union_areas(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").selectExpr("c_nationkey", "c_custkey * 37 % 211 AS x0", "c_custkey * 91 % 223 AS y0", "1 + c_custkey % 31 AS w", "1 + c_custkey % 17 AS h")
    shapes = rows.select("c_nationkey", _rectangle(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")).alias("shape"))
    return geo.merged(shapes, "c_nationkey", "shape").select("c_nationkey", F.round(geo.st_area("geometry")).cast("long").alias("area"))


# the published formulas, from WGS 84 by way of space coordinates to the Bessel ellipsoid, the sphere and the plane
_SWISS_SQL = f"""WITH p AS (SELECT c_custkey, radians(6 + (c_custkey * 37 % 4000) / 1000.0) AS lon, radians(46 + (c_custkey * 91 % 1500) / 1000.0) AS lat,
        0.00669437999014131699614 AS ew, 0.00667437223180214468 AS e2, 6377397.155 AS a, radians(46 + 57 / 60.0 + 8.66 / 3600) AS p0, radians(7 + 26 / 60.0 + 22.5 / 3600) AS l0 FROM customer),
    s AS (SELECT *, 6378137.0 / sqrt(1 - ew * sin(lat) ** 2) AS n FROM p),
    xyz AS (SELECT *, n * cos(lat) * cos(lon) - 674.374 AS x, n * cos(lat) * sin(lon) - 15.056 AS y, n * (1 - ew) * sin(lat) - 405.346 AS z FROM s),
    b0 AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z, sqrt(x * x + y * y) * (1 - e2)) AS f0 FROM xyz),
    {", ".join(f"b{i} AS (SELECT *, atan2(z + e2 * a / sqrt(1 - e2 * sin(f{i - 1}) ** 2) * sin(f{i - 1}), r) AS f{i} FROM b{i - 1})" for i in range(1, 7))},
    k AS (SELECT *, sqrt(e2) AS e, sqrt(1 + e2 / (1 - e2) * cos(p0) ** 4) AS alpha, a * sqrt(1 - e2) / (1 - e2 * sin(p0) ** 2) AS radius FROM b6),
    m AS (SELECT *, asin(sin(p0) / alpha) AS bern, alpha * (atan2(y, x) - l0) AS l, alpha * e / 2 * ln((1 + e * sin(p0)) / (1 - e * sin(p0))) - alpha * ln(tan(pi() / 4 + p0 / 2)) AS k0 FROM k),
    t AS (SELECT *, 2 * (atan(exp(alpha * ln(tan(pi() / 4 + f6 / 2)) - alpha * e / 2 * ln((1 + e * sin(f6)) / (1 - e * sin(f6))) + ln(tan(pi() / 4 + bern / 2)) + k0)) - pi() / 4) AS b FROM m),
    o AS (SELECT *, atan(sin(l) / (sin(bern) * tan(b) + cos(bern) * cos(l))) AS turned, cos(bern) * sin(b) - sin(bern) * cos(b) * cos(l) AS up FROM t)
    SELECT c_custkey, CAST(round(100 * (2600000 + radius * turned)) AS BIGINT) AS east_cm, CAST(round(100 * (1200000 + radius / 2 * ln((1 + up) / (1 - up)))) AS BIGINT) AS north_cm FROM o"""


@query(_SWISS_SQL)
def project_points(spark, sf_dir):
    geo.register(spark)
    point = geo.st_point(6 + F.col("c_custkey") * 37 % 4000 / 1000.0, 46 + F.col("c_custkey") * 91 % 1500 / 1000.0)
    rows = _table(spark, sf_dir, "customer").select("c_custkey", point.alias("geometry"))
    moved = rows.selectExpr("c_custkey", "ST_Transform(geometry, 'EPSG:4326', 'EPSG:2056') AS g")
    return moved.selectExpr("c_custkey", "cast(round(100 * ST_X(g)) as bigint) AS east_cm", "cast(round(100 * ST_Y(g)) as bigint) AS north_cm")


@query()
def context_windows(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("length(text) > 0")
    # a letter or digit at the beginning, in the middle and near the end of each text: a sentence holds it
    place = F.explode(F.array(F.lit(1), F.floor(F.length("text") / 2).cast("int") + 1, F.floor(F.length("text") * 0.9).cast("int") + 1)).alias("p")
    at = docs.select("doc_id", "text", place).withColumn("i", F.expr(r"regexp_instr(substring(text, p), '\\w')"))
    spans = at.where("i > 0").withColumn("start", F.col("p") + F.col("i") - 2).select("doc_id", "text", "start").distinct()
    return spans.select("doc_id", "start", context.context_window(40)("text", F.col("start"), F.col("start") + 1).alias("context"))


@query("""SELECT c_custkey AS key, '{"type":"Feature","geometry":{"type": "Point", "coordinates": [' || CAST(c_custkey % 360 - 180 AS DOUBLE) || ', ' || CAST(c_custkey % 170 - 85 AS DOUBLE) || ']},"properties":{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}}' AS value FROM customer""")
def geojson_output(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), geo.geojson_geometry(geo.st_point((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 170 - 85).cast("double"))).alias("geometry_json"), F.struct("c_name", "c_mktsegment").alias("properties"))
    return sinks.geojson_features(rows)


# -- services ------------------------------------------------------------------------------


@query("""SELECT CAST(doc_id AS VARCHAR) AS document_id, 0 AS start, 3 AS "end", substr(text, 1, 3) AS text, CASE WHEN doc_id % 3 > 0 THEN 'L' || doc_id % 3 END AS feature_identifier
    FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents) WHERE length(text) >= 3""")
def project_view(spark, sf_dir):
    """Documents, annotations as a recognizer and resolver of their own, and the tagged view."""
    p = project.Project(spark, folder(spark, "project"), "demo")
    p.create_documents(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    own = p.documents().where("length(text) >= 3").select(F.col("id").alias("document_id"), F.lit(0).alias("start"), F.lit(3).alias("end"), (F.col("id").cast("long") % 3).alias("k"))
    p.load_annotations(own.withColumn("loc_id", F.when(F.col("k") > 0, F.concat(F.lit("L"), "k")).otherwise("")), "gold")
    return p.view("gold").select("document_id", "start", "end", "text", "feature_identifier")


@query("""SELECT o_orderkey AS id, 'p' || o_custkey % 7 AS identifier FROM orders WHERE o_orderkey % 5 > 0""")
def resolve_manual(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("document_text"), F.col("o_orderkey").cast("int").alias("start"), (F.col("o_orderkey") + 1).cast("int").alias("end"), "o_custkey")
    known = o.where("id % 5 > 0").select("document_text", "start", "end", F.concat(F.lit("p"), F.col("o_custkey") % 7).alias("identifier"), F.lit(0).alias("pos"))
    later = known.withColumn("identifier", F.lit("a")).withColumn("pos", F.lit(1))
    return resolve.manual(known.unionByName(later))(o)


@query(f"WITH {_FEATURE_SQL}, q AS (SELECT p_partkey AS id, trim(p_name) AS name FROM part WHERE p_size < 10) SELECT q.id, f.id AS feature_id, row_number() OVER (PARTITION BY q.id ORDER BY f.id) AS position FROM q JOIN feature f ON lower(f.text) = lower(q.name)")
def candidate_gather(spark, sf_dir):
    index, part = _search(spark, sf_dir)
    mentions = part.where("p_size < 10").select(F.col("p_partkey").alias("id"), F.trim("p_name").alias("name"))
    return resolve.candidates(mentions, index, "exact", 1, limit=ALL).select("id", "feature_id", "position")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS text, CASE WHEN c_custkey % 4 = 0 THEN 'n' || c_nationkey END AS identifier, CASE WHEN c_custkey % 4 = 0 THEN n_name END AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def parse_texts(spark, sf_dir):
    """Texts to resolved documents in one call."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"), "c_nationkey")
    features = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("identifier"), "n_name")
    whole = lambda docs: docs.select("id", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))).alias("spans"))
    links = c.where("cast(id as long) % 4 = 0").select(F.col("id").alias("document_id"), F.concat(F.lit("n"), "c_nationkey").alias("identifier"))
    parsed = facade.parse(spark, c, whole, lambda refs: refs.join(links, "document_id").select("id", "identifier"), features, ("n_name",))
    return parsed.select("id", F.explode("toponyms").alias("t")).select("id", "t.text", "t.identifier", "t.n_name")


# one span in nine has a place of its own, so half of the conflicts are of places alone
_PLACED = """SELECT document_id % 100 AS document_id, start, "end", kind % 2 AS kind, CASE WHEN id % 4 > 0 THEN CAST(start % 3 AS DOUBLE) END AS lat, CASE WHEN id % 4 > 0 THEN CAST(CASE WHEN id % 9 = 0 THEN id % 180 ELSE 7 END AS DOUBLE) END AS lon FROM spans"""


@query(f"""WITH {_SPANS}, placed AS ({_PLACED}) SELECT document_id, start, "end", count(DISTINCT kind) AS ids, count(DISTINCT CASE WHEN lat IS NOT NULL THEN lat || ',' || lon END) AS places FROM placed
    GROUP BY 1, 2, 3 HAVING count(DISTINCT kind) > 1 OR count(DISTINCT CASE WHEN lat IS NOT NULL THEN lat || ',' || lon END) > 1""")
def gold_conflicts(spark, sf_dir):
    known = F.expr("id % 4 > 0")
    gold = _spans(spark, sf_dir).select(
        (F.col("document_id") % 100).alias("document_id"), "start", "end", (F.col("kind") % 2).cast("string").alias("identifier"),
        F.when(known, F.col("start") % 3).cast("double").alias("latitude"), F.when(known, F.expr("if(id % 9 = 0, id % 180, 7)")).cast("double").alias("longitude"),
    )
    return evaluate.gold_conflicts(gold).select("document_id", "start", "end", "ids", "places")


_SCORES = "count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g) AS fp, count(*) FILTER (WHERE NOT p) AS fn"


@query(f"""WITH {_SPANS}, m AS (SELECT kind, document_id, start, "end", bool_or(id % 3 > 0) AS g, bool_or(id % 5 > 0) AS p FROM spans GROUP BY ALL HAVING bool_or(id % 3 > 0) OR bool_or(id % 5 > 0)),
    c AS (SELECT 0 AS level, kind, document_id, {_SCORES} FROM m GROUP BY kind, document_id UNION ALL SELECT 1, kind, NULL, {_SCORES} FROM m GROUP BY kind UNION ALL SELECT 2, NULL, NULL, {_SCORES} FROM m)
    SELECT level, kind, document_id, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 9) AS recall FROM c""")
def span_report(spark, sf_dir):
    """Scores of documents, corpora and all spans together."""
    spans = _spans(spark, sf_dir)
    rows = evaluate.report(spans.where("id % 3 > 0"), spans.where("id % 5 > 0"), [["kind", "document_id"], ["kind"], []])
    return rows.select("level", "kind", "document_id", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def _part_mentions(spark, sf_dir):
    """Names of all parts as mentions, and the parts as features with a population."""
    index, part = _search(spark, sf_dir)
    own = part.select(F.col("p_partkey").alias("id"), F.trim("p_name").alias("name"), F.lit("context").alias("context"))
    ids = _places(spark, sf_dir)[0]
    known = part.select(F.col("p_partkey").cast("string").alias("identifier"), (F.col("p_size") * 1000).cast("string").alias("population"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("description"), "p_size")
    features = known.join(ids.select(F.col("id").alias("feature_id"), "identifier"), "identifier")
    return index, own, features


_CANDIDATES = f"{_FEATURE_SQL}, c AS (SELECT p.p_partkey AS id, f.id AS feature_id, f.identifier, t.p_size FROM part p JOIN feature f ON lower(f.text) = lower(trim(p.p_name)) JOIN part t ON CAST(t.p_partkey AS VARCHAR) = f.identifier)"
#: an embedder under which all texts are alike: what is left is priors, order and reranking
_alike = lambda text: F.array(F.lit(1.0), F.length(text) * 0.0)


@query(f"WITH {_CANDIDATES} SELECT id, identifier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_size DESC, feature_id) AS r FROM c) WHERE r = 1")
def tiered_prior(spark, sf_dir):
    """Every mention resolved among its exact candidates, the most populous one wins."""
    index, mentions, features = _part_mentions(spark, sf_dir)
    return resolve.tiered(mentions, index, features, folder(spark, "tiered"), least=0.5, embed=_alike, weight=0.5, limit=ALL).select("id", "identifier")


@query(f"WITH {_CANDIDATES}, s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY feature_id) AS r FROM c) SELECT id, identifier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_size, feature_id) AS best FROM s WHERE r <= 20) WHERE best = 1")
def tiered_rerank(spark, sf_dir):
    """The same with a reranker over the shortlist of 20: it takes the least populous one."""
    index, mentions, features = _part_mentions(spark, sf_dir)
    return resolve.tiered(mentions, index, features, folder(spark, "tiered"), least=0.5, embed=_alike, rerank=lambda rows: rows.withColumn("score", -F.col("population").cast("double")), limit=ALL).select("id", "identifier")


@query(f"WITH {_CANDIDATES} SELECT id || '' AS context, 'size ' || p_size AS description, CAST(identifier = CAST(id AS VARCHAR) AS INTEGER) AS label FROM c")
def training_pairs(spark, sf_dir):
    """All candidates of all mentions, with whether they are right."""
    index, mentions, features = _part_mentions(spark, sf_dir)
    own = mentions.select("id", "name", F.col("id").cast("string").alias("context"), F.col("id").cast("string").alias("gold"))
    return resolve.training_pairs(own, index, features.select("feature_id", "identifier", "description"), limit=ALL)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _places_of_words(words: pd.Series, between: pd.Series) -> pd.Series:
    """Spans of words from their lengths and those of what lies before each: running sums."""
    out = []
    for w, b in zip(words, between, strict=True):
        if w is None or b is None or not len(w):
            out.append([])
            continue
        ends = np.cumsum(np.asarray(w) + np.asarray(b)[: len(w)])
        out.append([{"start": int(e - n), "end": int(e)} for e, n in zip(ends, w, strict=True)])
    return pd.Series(out, index=words.index, dtype=object)


def capitalised_spans(text_column):
    """Spans of the capitalised words, in time linear in the text."""
    pattern = r"\b[A-Z][a-z]+\b"
    return _places_of_words(F.transform(F.regexp_extract_all(text_column, F.lit(pattern), F.lit(0)), F.length), F.transform(F.split(text_column, pattern, -1), F.length))


@query()
def trained_recognizer(spark, sf_dir):
    """Spans in every document by a tagger that has learnt the capitalised words of half of them: a test holds it to these."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    spans = capitalised_spans(F.col("text"))
    learnt = tagger.PerceptronRecognizer().fit(docs.where("text is not null and id % 2 = 1").select("text", spans.alias("spans")), epochs=2, partitions=spark.sparkContext.defaultParallelism)
    return learnt(docs).select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.end")


@query("""SELECT o_orderpriority AS corpus, count(*) AS gold, round(count(*) FILTER (WHERE o_custkey % 2 = 0) / count(*), 9) AS exact_accuracy,
    round(count(*) FILTER (WHERE o_totalprice < 50000) / count(*), 9) AS accuracy_1_km,
    round(count(*) FILTER (WHERE o_totalprice < 100000) / count(*), 9) AS accuracy_10_km,
    round(count(*) FILTER (WHERE o_totalprice < 150000) / count(*), 9) AS accuracy_50_km,
    round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 9) AS coverage,
    round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 9) AS abstention,
    round(count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) / count(*), 9) AS invalid_rate,
    round(count(*) FILTER (WHERE o_custkey % 3 = 0) / count(*), 9) AS candidate_recall FROM orders GROUP BY 1""")
def protocol_metrics(spark, sf_dir):
    n = lambda c: F.count_if(F.expr(c)).alias
    counts = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("corpus")).agg(
        F.count("*").alias("gold"), n("o_orderstatus = 'F'")("resolved"), n("o_orderstatus = 'O'")("abstained"), n("o_orderstatus not in ('F', 'O')")("invalid"),
        F.count("*").alias("exact_eligible"), n("o_custkey % 2 = 0")("exact_correct"), F.count("*").alias("coordinate_eligible"),
        n("o_totalprice < 50000")("within_1_km"), n("o_totalprice < 100000")("within_10_km"), n("o_totalprice < 150000")("within_50_km"), F.count("*").alias("candidate_eligible"), n("o_custkey % 3 = 0")("candidate_found"),
    )
    return evaluate.protocol_metrics(counts).select("corpus", "gold", *[F.round(c, 9).alias(c) for c in ("exact_accuracy", "accuracy_1_km", "accuracy_10_km", "accuracy_50_km", "coverage", "abstention", "invalid_rate", "candidate_recall")])


@query(f"""WITH {_SPANS}, l AS (SELECT *, ['en', 'de', 'fr', 'xx'][kind + 1] AS language FROM spans), g AS (SELECT DISTINCT language, document_id, start, "end" FROM l WHERE id % 3 > 0 AND kind < 3), p AS (SELECT DISTINCT language, document_id, start, "end" FROM l WHERE id % 5 > 0 AND kind < 3)
    SELECT language, count(*) FILTER (WHERE g.document_id IS NOT NULL AND p.document_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.document_id IS NULL) AS fp, count(*) FILTER (WHERE p.document_id IS NULL) AS fn FROM g FULL JOIN p USING (language, document_id, start, "end") GROUP BY 1""")
def language_counts(spark, sf_dir):
    spans = _spans(spark, sf_dir).withColumn("language", F.get(F.array(*map(F.lit, ("en", "de", "fr", "xx"))), F.col("kind").cast("int")))
    counts, _ = evaluate.score_languages(spans.where("id % 3 > 0"), spans.where("id % 5 > 0"), ["en", "de", "fr", "it"])
    return counts.select("language", "tp", "fp", "fn")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
