"""Feature blocks as DataFrames: projection, name explosion and merged geometries.

A block's expressions are Spark SQL over its source, aliased src, and its raw join
clauses.  Bare columns of the source are qualified, so that joined tables may hold
columns of the same names.  A join ON ST_Within, ST_Contains or ST_Intersects of the
source and the joined table is planned as an equi-join on grid cells; the pairs found
take the table's place, keyed by the source's row.
"""

from __future__ import annotations

import difflib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from toposcope.functions import geo
from toposcope.plans.config import Block, ConfigError, split_alias

ROW = "__rid"
_LEXEME = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|[A-Za-z_]\w*(?:\s*\.\s*(?:[A-Za-z_]\w*|`[^`]*`|\"[^\"]*\"))*\s*\(?|\d[\w.]*")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _bare(token: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_]\w*\s*", token))


def bare_references(expression: str) -> list[str]:
    """Unqualified words that may be columns: no literals, quoted or qualified names, functions."""
    return [m.group().strip() for m in _LEXEME.finditer(expression) if _bare(m.group())]


def qualifiers(expression: str) -> set[str]:
    """Table aliases that an expression reads."""
    return {m.group().split(".")[0].strip() for m in _LEXEME.finditer(expression) if re.match(r"[A-Za-z_]\w*\s*\.", m.group()) and not m.group().rstrip().endswith("(")}


def qualify(expression: str, columns: list[str], table: str = "src") -> str:
    known = {c.lower(): c.replace("`", "``") for c in columns}

    def one(m: re.Match) -> str:
        word = m.group().strip()
        return f"{table}.`{known[word.lower()]}`" + m.group()[len(m.group().rstrip()) :] if _bare(m.group()) and word.lower() in known else m.group()

    return _LEXEME.sub(one, expression)


def qualify_join(clause: str, columns: list[str]) -> str:
    """Only the condition after the first ON is rewritten; USING and CROSS JOIN stay."""
    m = re.search(r"\sON\s", clause, re.I)
    return clause if m is None else clause[: m.end()] + qualify(clause[m.end() :], columns)


_SPATIAL = re.compile(r"^\s*(?P<kind>(?:LEFT|INNER)?\s*(?:OUTER\s+)?JOIN)\s+(?P<table>`[^`]+`|\"[^\"]+\"|\w+)(?:\s+AS)?(?:\s+(?P<alias>(?!ON\b)\w+))?\s+ON\s+ST_(?P<predicate>Within|Contains|Intersects)\s*\(", re.I)


def spatial_parts(clause: str) -> dict | None:
    """kind, table, alias, predicate, the two arguments and the rest of a spatial join clause; None of others."""
    m = _SPATIAL.match(clause)
    if m is None:
        return None
    depth, start, args = 1, m.end(), []
    for at in range(m.end(), len(clause)):
        depth += {"(": 1, ")": -1}.get(clause[at], 0)
        if (clause[at] == "," and depth == 1) or depth == 0:
            args.append(clause[start:at].strip())
            start = at + 1
        if depth == 0:
            break
    rest = clause[start:].strip()
    if depth or len(args) != 2 or not (rest == "" or re.match(r"AND\b", rest, re.I)):
        return None
    table = m["table"].strip('`"')
    return {"kind": m["kind"], "table": table, "alias": m["alias"] or table, "predicate": m["predicate"].lower(), "args": args, "rest": rest}


class BlockPlan:
    """One block over registered temporary views named like the sources."""

    def __init__(self, spark: SparkSession, block: Block):
        self.spark, self.block, self._joins = spark, block, None
        geo.register(spark)
        self.columns = [c for c in spark.table(block.source).columns if c != ROW]
        self._check()

    def _check(self) -> None:
        """The identifier and the geometry read the block's own source alone."""
        for what in ("identifier", "geometry"):
            expression = getattr(self.block, what)
            if not expression:
                continue
            if others := qualifiers(expression) - {"src", self.block.source}:
                raise ConfigError(f"block {self.block.source}: {what} reads joined tables: {', '.join(sorted(others))}")
            self._sql(f"SELECT {self._q(expression)} FROM `{self.block.source}` AS src", what)

    def _sql(self, query: str, what: str = "an expression") -> DataFrame:
        """The query, with unknown columns told in the words of the configuration."""
        try:
            return self.spark.sql(query)
        except AnalysisException as e:
            if not str(e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
            name = str(e.getMessageParameters().get("objectName", "")).replace("`", "")
            hints = difflib.get_close_matches(name.split(".")[-1], self.columns, 3, 0.5) or difflib.get_close_matches(name.split(".")[-1].lower(), self.columns, 3, 0.5)
            also = f"; did you mean {' or '.join(hints)}?" if hints else f"; {self.block.source} has {', '.join(self.columns)}"
            raise ConfigError(f"block {self.block.source}: {what} reads the unknown column {name}{also}") from e

    def _q(self, expression: str) -> str:
        return qualify(expression, self.columns)

    def _join(self, clause: str) -> str:
        parts = spatial_parts(clause)
        if parts is None:
            return qualify_join(clause, self.columns)
        args = [qualify(a, self.columns) for a in parts["args"]]
        own = [{q for q in qualifiers(a)} for a in args]
        if own != [{"src"}, {parts["alias"]}] and own != [{parts["alias"]}, {"src"}]:
            raise ConfigError(f"block {self.block.source}: a spatial join needs one argument of the source and one of {parts['alias']}")
        predicate = parts["predicate"]
        if own[0] != {"src"}:
            args, predicate = args[::-1], {"within": "contains", "contains": "within"}.get(predicate, predicate)
        left = self._sql(f"SELECT src.`{ROW}`, {args[0]} AS shape FROM `{self.block.source}` AS src", "a join")
        table = self.spark.table(parts["table"])
        right = self._sql(f"SELECT *, {args[1]} AS other FROM `{parts['table']}` AS `{parts['alias']}`", "a join")
        right = right.select(F.struct(*[c for c in table.columns if c != ROW]).alias("__t"), "other")
        view = f"__pairs_{uuid.uuid4().hex}"
        geo.geometry_join(left, right, predicate).select(F.col(ROW).alias("__of"), "__t.*").createOrReplaceTempView(view)
        return f"{parts['kind']} `{view}` AS `{parts['alias']}` ON src.`{ROW}` = `{parts['alias']}`.__of {qualify(parts['rest'], self.columns)}"

    def _from(self) -> str:
        if self._joins is None:
            self._joins = [self._join(j) for j in self.block.joins]
        return " ".join([f"FROM `{self.block.source}` AS src", *self._joins])

    def _id(self) -> str:
        return f"CAST(({self._q(self.block.identifier)}) AS STRING)"

    def features(self) -> DataFrame:
        """identifier, source, data (JSON, null keys kept) and geometry: the first value that is not null, by row."""
        keys = [split_alias(d) for d in self.block.data]
        # nulls are left out before the least row number is taken
        picks = [f"min_by({v}, src.`{ROW}`) FILTER (WHERE ({v}) IS NOT NULL) AS {quoted(k)}" for e, k in keys for v in (self._q(e),)]
        shape = self._q(self.block.geometry) if self.block.geometry else None
        geometry = f"min_by({shape}, src.`{ROW}`) FILTER (WHERE ({shape}) IS NOT NULL)" if shape else "CAST(NULL AS BINARY)"
        rows = self._sql(f"SELECT {self._id()} AS identifier, {', '.join([*picks, geometry + ' AS geometry'])} {self._from()} WHERE ({self._q(self.block.identifier)}) IS NOT NULL GROUP BY 1")
        data = F.to_json(F.struct(*[F.col(quoted(k)) for _, k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
        return rows.select("identifier", F.lit(self.block.source).alias("source"), data.alias("data"), "geometry")

    def names(self) -> DataFrame:
        """Distinct (identifier, text): trimmed, neither null nor blank; list expressions use explode."""
        out = None
        for name in self.block.names:
            rows = self._sql(f"SELECT {self._id()} AS identifier, {self._q(name)} AS part {self._from()} WHERE ({self._q(self.block.identifier)}) IS NOT NULL")
            one = rows.select("identifier", F.trim(F.col("part").cast("string")).alias("text")).where(F.col("text") != "")
            out = one if out is None else out.unionByName(one)
        return out.distinct()

    def merged_geometries(self) -> DataFrame | None:
        """Geometries of identifiers that occur in more than one row of the source; joins cannot change them."""
        if self.block.geometry is None:
            return None
        rows = self._sql(f"SELECT {self._id()} AS identifier, {self._q(self.block.geometry)} AS shape FROM `{self.block.source}` AS src WHERE ({self._q(self.block.identifier)}) IS NOT NULL")
        return geo.merged(rows, "identifier", "shape", least=2)

    def whole(self) -> DataFrame:
        """features with the merged geometries in place."""
        rows, merged = self.features(), self.merged_geometries()
        if merged is None:
            return rows
        return rows.join(merged.withColumnRenamed("geometry", "merged"), "identifier", "left").select("identifier", "source", "data", F.coalesce("merged", "geometry").alias("geometry"))
