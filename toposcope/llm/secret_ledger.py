"""Incremental blob ledger for secret scans, in DataFrame operations only.

Every historical version of a text is addressed by the SHA-256 of its content.  A
ledger table keeps, for each pair of blob and rule version, what the scan found.  A run
scans only the pairs that the ledger lacks, appends them, and joins the findings back to
every path (row) that holds the blob.

Defined results: a null text is the empty text; repeated rows each get the findings of
their blob; an empty table gives an empty result; extra columns of the input are kept by
`scan_paths` unless they have the name of an added column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from toposcope.llm._shared import scratch, table


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression; group: what must have at least `least` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


_KEYWORD = r"(?i:(password|passwd|secret|token|api_?key))"
BASE_RULES = (
    Rule("assign", 1, _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("githubtoken", 1, r"gh[pousr]_[A-Za-z0-9]{36}", 0, 1),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("googlekey", 1, r"AIza[A-Za-z0-9_-]{35}", 0, 1),
)
RULES = BASE_RULES + EXTRA_RULES

#: Cheap tests, none of which is false where the rule matches and passes its length.
_PRESENT = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}

SPAN = "array<struct<kind:string,start:int,end:int>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule in code points, leftmost and non-overlapping.

    The matches and the pieces between them come from the same pattern; their lengths
    in characters, added up, are the positions.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    size = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    steps = F.arrays_zip(
        F.transform(whole, F.length).alias("width"),
        F.transform(size, F.length).alias("size"),
        F.slice(pieces, 1, F.size(whole)).alias("gap"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + x["gap"]
        span = F.struct(F.lit(rule.name).alias("kind"), here.alias("start"), (here + x["width"]).alias("end"))
        grown = F.concat(F.coalesce(acc["out"], F.array().cast(SPAN)), F.array(span))
        return F.struct(
            (here + x["width"]).alias("at"),
            F.when(x["size"] >= rule.least, grown).otherwise(acc["out"]).alias("out"),
        )

    found = F.aggregate(steps, start, step)["out"]
    present = text.rlike(_PRESENT.get(rule.name, rule.pattern))
    return F.when(present, F.coalesce(found, F.array().cast(SPAN))).otherwise(F.array().cast(SPAN))


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = f"blob binary, rule string, rule_version int, found {SPAN}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # the first run has no ledger yet
        return spark.createDataFrame([], schema)


def update_ledger(versions: DataFrame, text_col: str, ledger_path: str, rules=RULES) -> DataFrame:
    """Scan the pairs of blob and rule version that the ledger lacks; returns the ledger.

    A repeated run scans nothing and appends nothing.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.sha2(text.cast("binary"), 256).alias("hex"), text.alias("body")).select(F.unhex("hex").alias("blob"), "body")
    known = _ledger(spark, ledger_path)
    tags = [f"{r.name}:{r.version}" for r in rules]
    seen = known.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "rule_version")).alias("seen"))
    # one copy of each content: partial aggregation drops copies before the shuffle
    distinct = blobs.groupBy("blob").agg(F.first("body").alias("body"))
    if not known.isEmpty():
        distinct = distinct.join(seen, "blob", "left")
    else:
        distinct = distinct.withColumn("seen", F.lit(None).cast("array<string>"))
    todo = distinct.select("blob", "body", F.array_except(F.array(*map(F.lit, tags)), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    rows = [
        F.when(
            F.array_contains("todo", tag),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), _spans(F.col("body"), r).alias("found")),
        )
        for r, tag in zip(rules, tags, strict=True)
    ]
    fresh = todo.where(F.size("todo") > 0).select("blob", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r")).select("blob", "r.*")
    fresh.write.mode("append").parquet(ledger_path)
    return _ledger(spark, ledger_path)


def findings_by_blob(ledger: DataFrame, rules=RULES) -> DataFrame:
    """One row for each blob with a finding: all its spans by start, then rule order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    current = F.array(*[F.lit(f"{r.name}:{r.version}") for r in rules])
    return (
        ledger.where((F.size("found") > 0) & F.array_contains(current, F.concat_ws(":", "rule", "rule_version")))
        # an executor lost while appending can leave no duplicate, a second writer could
        .dropDuplicates(["blob", "rule", "rule_version"])
        .groupBy("blob")
        .agg(
            F.transform(
                F.array_sort(F.flatten(F.collect_list(F.transform("found", lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))))),
                lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
            ).alias("spans")
        )
    )


def scan_paths(versions: DataFrame, ledger_path: str | None = None, text_col: str = "text", rules=RULES) -> DataFrame:
    """versions plus `spans`: array of (kind, start, end), empty if nothing was found."""
    spark = versions.sparkSession
    ledger = update_ledger(versions, text_col, ledger_path or scratch(spark), rules)
    found = findings_by_blob(ledger, rules)
    keyed = versions.drop("spans").withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    joined = keyed.join(found.withColumnRenamed("blob", "__blob"), "__blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN))).drop("__blob")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with the union of spans (sorted by start) replaced by mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return (
            F.when(x["end"] <= acc["at"], acc)
            .when(x["start"] < acc["at"], F.struct(x["end"].alias("at"), acc["out"].alias("out")))
            .otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out")))
        )

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, 2147483647)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts stay out of the join: only the address of each goes along
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = update_ledger(docs, "text", scratch(spark))
    found = findings_by_blob(ledger)
    paths = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob"))
    spans = F.coalesce("spans", F.array().cast(SPAN))
    base = F.filter(spans, lambda x: x["kind"].isin([r.name for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return paths.join(found, "blob", "left").select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def _sql_of(rule: Rule, rank: int) -> str:
    """The rule's spans in one text, in SQL: the same sums over matches and the pieces between them."""
    pattern = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}.get(rule.name, rule.pattern).replace("'", "''")
    return f"""SELECT blob, '{rule.name}' AS kind, {rank} AS rank, start, start + length(m[i]) AS stop FROM (
        SELECT blob, m, g, i, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
            SELECT blob, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT blob, regexp_extract_all(body, '{pattern}', 0) AS m, regexp_extract_all(body, '{pattern}', {rule.group}) AS g, regexp_split_to_array(body, '{pattern}') AS p FROM blobs)))
        WHERE length(g[i]) >= {rule.least}"""


_FOUND = " UNION ALL ".join(_sql_of(r, i) for i, r in enumerate(RULES))
_IN_ORDER = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
ORACLE_SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), blobs AS (SELECT DISTINCT body AS blob, body FROM docs), found AS ({_FOUND}),
    byblob AS (SELECT blob, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        {_IN_ORDER} FILTER (WHERE rank < {len(BASE_RULES)}) AS base, {_IN_ORDER} AS spans FROM found GROUP BY blob)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN byblob ON body = blob"""
