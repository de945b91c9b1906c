"""The query surface: one object over a set of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.scalars import finding_id
from factline.operators import audit as A
from factline.operators import extract, facts, graph
from factline.operators.cache import FactCache
from factline.operators.interpret import interpret
from factline.operators.rules import Rule
from factline.sources.files import mentions, scan_files, select_files

#: Query types that are a tool and a kind.
PRESET = {"as-any": ("type-safety", "AS_ANY_CAST"), "hook-calls": ("hooks", "HOOK_CALL"), "effect-locations": ("effects", "EFFECT_LOCATION")}
#: kind -> finding. What is missing here is no finding.
FINDINGS = {
    "AS_ANY_CAST": "as-any", "NON_NULL_ASSERTION": "non-null-assertion", "TRUST_BOUNDARY_CAST": "trust-boundary-gap", "JSON_PARSE_CALL": "trust-boundary-gap", "RAW_ROLE_CHECK": "RAW_ROLE_CHECK", "TIMER_RACE": "eliminable-effect", "DERIVED_STATE": "eliminable-effect",
    "EVENT_HANDLER_DISGUISED": "eliminable-effect", "DEAD_EXPORT": "dead-export", "CIRCULAR_DEPENDENCY": "circular-dep", "COMPLEXITY_HOTSPOT": "complexity-hotspot", "UNBRANDED_ID_PARAM": "branded-type-gap", "DIRECT_STORAGE_CALL": "direct-storage", "PROCESS_ENV_ACCESS": "raw-env", "RAW_DATE_CONSTRUCTOR": "raw-date", "CATCH_ERROR_ANY": "catch-any",
}


class Engine:
    """``files``: path, version, content (see :func:`factline.sources.files.scan_files`)."""

    def __init__(self, spark: SparkSession, files: DataFrame | str, aliases: dict[str, str] | None = None, cache: FactCache | None = None) -> None:
        self.spark, self.aliases, self.cache = spark, aliases, cache
        self._edges: DataFrame | None = None
        self.files = scan_files(spark, files, "all") if isinstance(files, str) else files

    def observe(self, files: DataFrame, tools: tuple[str, ...]) -> DataFrame:
        """Observations of some tools; with a cache, only files of new content are read."""
        run = lambda f: extract.observe(f, tools)
        return self.cache.observe(files, "+".join(tools), run) if self.cache else run(files)

    def types(self) -> list[str]:
        return sorted({*extract.TOOLS, *PRESET, "dead-exports", "circular", "complexity-report", "interpret-effects", "interpret-hooks", "interpret-dead-code"})

    def query(self, kind_of: str, kind: str | None = None, count: bool = False, test_files: str = "production") -> DataFrame:
        """One query type: a tool's observations, or an interpreter's assessments."""
        files = select_files(self.files.drop("is_test"), test_files)
        if kind_of in PRESET:
            tool, only = PRESET[kind_of]
            out = facts.kind_filter(self.observe(files, (tool,)), [only])
        elif kind_of == "dead-exports":
            out = self.dead_exports()
        elif kind_of == "circular":
            out = self.cycles()
        elif kind_of == "complexity-report":
            out = extract.complexity(files).select(F.lit("FUNCTION_COMPLEXITY").alias("kind"), F.col("path").alias("file"), "line", F.col("parent").alias("name"), "complexity", "depth")
        elif kind_of == "interpret-effects":
            out = interpret(extract.effect_flags(self.observe(files, ("effects", "side-effects", "storage"))), "effects")
        elif kind_of == "interpret-hooks":
            out = self.hooks(files)
        elif kind_of == "interpret-dead-code":
            out = self.dead_code()
        elif kind_of in extract.TOOLS:
            out = self.observe(files, (kind_of,))
        else:
            raise ValueError(f"unknown query {kind_of!r}; there are {', '.join(self.types())}")
        out = out.filter(F.col("kind") == kind) if kind else out
        return out.groupBy("kind").agg(F.count("*").alias("n")) if count else out

    def batch(self, kinds: list[str]) -> dict[str, DataFrame]:
        """Several queries; those that are plain tools share one scan's plan."""
        return {k: self.query(k) for k in kinds}

    def edges(self) -> DataFrame:
        """Import edges of all files, found once for an engine."""
        if self._edges is None:
            self._edges = extract.import_edges(self.files, aliases=self.aliases).persist()
        return self._edges

    def consumers(self, file: str) -> DataFrame:
        """Files that import ``file``, among those whose text can."""
        near = mentions(self.files, file).unionByName(self.files.filter(F.col("path") == file))
        return extract.import_edges(near, aliases=self.aliases).filter(F.col("dst") == file).select(F.col("src").alias("file")).distinct()

    def symbol(self, name: str) -> DataFrame:
        """Files that import the symbol, then others that render it."""
        a = self.edges().filter(F.col("name").isin(name, f"* as {name}")).select(F.col("src").alias("file")).distinct().withColumn("via", F.lit("import"))
        b = self.files.filter(F.col("content").rlike(rf"<{name}\b")).select(F.col("path").alias("file")).join(a, "file", "left_anti")
        return a.unionByName(b.withColumn("via", F.lit("render")))

    def reexports(self) -> DataFrame:
        """What files pass on: file, name ("* from ..." for all), line."""
        e = self.edges().filter("reexport")
        return e.select(F.col("src").alias("file"), F.when(F.col("name") == "*", F.concat(F.lit("* from "), "dst")).otherwise(F.col("name")).alias("name"), "line")

    def dead_exports(self) -> DataFrame:
        exports = extract.exports_of(select_files(self.files.drop("is_test"), "production")).withColumn("is_reexport", F.lit(False))
        left = A.dead_export_chain(exports, self.edges().filter("NOT reexport"), self.reexports())
        # What a barrel imports from a file to pass it on counts as the barrel's use.
        passed = self.edges().filter("reexport").select(F.col("dst").alias("file"), "name").distinct()
        left = left.join(passed, ["file", "name"], "left_anti").join(passed.filter("name = '*'").select("file").distinct(), "file", "left_anti")
        return left.select(F.lit("DEAD_EXPORT").alias("kind"), "file", "name", "line")

    def cycles(self) -> DataFrame:
        found = graph.cycles(self.edges().select("src", "dst").distinct())
        return found.select(F.lit("CIRCULAR_DEPENDENCY").alias("kind"), F.col("path")[0].alias("file"), F.array_join("path", " -> ").alias("name"), F.lit(1).alias("line"))

    def hooks(self, files: DataFrame) -> DataFrame:
        calls = self.observe(files, ("hooks",))
        source = self.edges().select(F.col("src").alias("file"), "name", F.col("dst").alias("import_source")).dropDuplicates(["file", "name"])
        builtin = F.col("name").rlike("^use(State|Effect|LayoutEffect|Memo|Callback|Ref|Context|Reducer|Id|Transition)$")
        ambient = F.col("name").rlike("^use(Router|Theme|Toast|MediaQuery|SearchParams)$")
        return interpret(calls.drop("kind").join(source, ["file", "name"], "left").withColumns({"is_builtin": builtin, "is_ambient": ambient}), "hooks")

    def dead_code(self) -> DataFrame:
        e = self.edges()
        folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
        uses = e.groupBy(F.col("dst").alias("file"), "name").agg(F.countDistinct("src").alias("n"), F.count_if(~F.startswith("src", folder("dst"))).alias("n_outside"))
        ring = self.cycles().select(F.explode(F.split("name", " -> ")).alias("file")).distinct().withColumn("in_cycle", F.lit(True))
        own = extract.exports_of(select_files(self.files.drop("is_test"), "production")).withColumn("is_reexport", F.lit(False))
        barrels = self.reexports().filter(F.col("file").rlike(r"(^|/)index\.tsx?$") & ~F.col("name").startswith("* from ")).withColumn("is_reexport", F.lit(True))
        x = own.unionByName(barrels).join(uses, ["file", "name"], "left").join(ring, "file", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        # A barrel's entry that nobody outside takes is no dead export of its own.
        n = F.when(F.col("is_reexport"), F.greatest(zero("n"), F.lit(2))).otherwise(zero("n"))
        x = x.select("file", "name", "line", n.alias("n_consumers"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), A.holds_any(F.col("file"), ("pages/api/", "server/")).alias("dynamic"), "is_reexport", zero("n_outside").alias("n_outside"))
        return interpret(x, "dead_code")

    def findings(self) -> DataFrame:
        """All finding streams, one row per id (the surest first), with priorities."""
        files = select_files(self.files.drop("is_test"), "production")
        tools = tuple(t for t in extract.TOOLS if t not in ("markdown", "test-quality", "pw-parity"))
        cols = ["kind", "file", "line", "name", "confidence", "metric"]
        none = F.lit(None).cast("long")
        streams = [
            self.observe(files, tools).select("kind", "file", "line", "name", F.lit("high").alias("confidence"), none.alias("metric")),
            self.query("interpret-effects").select("kind", "file", F.col("effect_line").alias("line"), F.col("parent").alias("name"), "confidence", none.alias("metric")),
            self.dead_exports().select("kind", "file", "line", "name", F.lit("high").alias("confidence"), none.alias("metric")),
            self.cycles().select("kind", "file", "line", "name", F.lit("high").alias("confidence"), none.alias("metric")),
            extract.complexity(files).filter("complexity >= 10").select(F.lit("COMPLEXITY_HOTSPOT").alias("kind"), F.col("path").alias("file"), "line", F.col("parent").alias("name"), F.lit("high").alias("confidence"), F.col("complexity").alias("metric")),
        ]
        out = streams[0]
        for s in streams[1:]:
            out = out.unionByName(s)
        out = out.select(cols).withColumn("finding", facts.lookup(F.col("kind"), FINDINGS))
        out = out.filter("finding IS NOT NULL AND confidence <> 'low'").withColumn("id", finding_id(F.col("file"), F.col("line"), F.col("finding")))
        rank = facts.lookup(F.col("confidence"), {"high": 3, "medium": 2}, 1)
        out = facts.dedupe(out, ["id"], [F.desc(rank), F.asc("kind"), F.asc("name")])
        word = A.evidence(F.col("kind"), F.col("file"), F.col("line"), F.col("name"), F.col("metric"))
        out = out.withColumns({"evidence": word, "category": A.category(F.col("finding")), "track": A.track(F.col("file")), "sub_kind": F.lit(None).cast("string"), "risk": F.lit(None).cast("string"), "is_type_only": F.lit(False)})
        ranked = interpret(out.drop("kind"), "priority", Rule("P4", "true"))
        return ranked.select("id", "finding", F.col("kind").alias("priority"), "category", "track", "file", "line", "name", "metric", "evidence")

    def audit(self, least: str = "P5", previous: DataFrame | None = None, track: str | None = None) -> dict[str, DataFrame]:
        """Findings of priority ``least`` or above (of one track, "fe" or "bff", if given) in order, their number by
        track and priority, and their difference from a previous run's."""
        found = facts.priority_cut(self.findings(), least)
        found = found.filter(F.col("track") == track) if track else found
        out = {"findings": found.orderBy(facts.rank_of(F.col("priority")), "file", "line")}
        out["summary"] = found.groupBy("track").pivot("priority", [f"P{k}" for k in range(1, 6)]).count().fillna(0)
        if previous is not None:
            out["diff"] = facts.run_diff(previous, found, "id", "priority").filter("state <> 'same'")
        return out
