"""The engine as functions for a client: build a graph from a folder, keep it, and ask it questions. Answers are plain values.

Every function works on DataFrames and collects only its answer, whose size the limits bound.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build as B
from .operators import context as X
from .operators import impact as I
from .operators import symbols as Y
from .operators.incremental import apply_update, hash_diff, merge_trace
from .plans.lineage import cut
from .plans.nodes import node
from .sources import records
from .sources.files import read_matches, repo_files

#: Sections that a snapshot holds.
SECTIONS = ("functions", "classes", "imports", "reexports", "calls", "arguments", "parameters", "returns", "types", "variable_states", "routes", "database_ops", "errors", "literals", "constants", "execution_edges", "data_flow", "taint_sources", "security_sinks", "sanitizers", "security_findings", "symbol_index", "files", "matches")
#: Most names of changed files that an answer lists.
REPORTED = 100


@dataclass
class Engine:
    spark: SparkSession
    directory: str
    snapshot: str
    tests: bool = True

    def build_graph(self, force: bool = False) -> dict:
        """Reads the snapshot if nothing changed since, else builds the graph and writes a new version.

        Only files that were added or changed are parsed; the matches of the others come from the snapshot, without those of deleted files. Names are resolved over all matches, so an edit,
        a rename or a delete ends in the same graph as a full build.
        """
        files = repo_files(self.spark, self.directory, self.tests)
        names: list[str] = []
        if not force and records.has_snapshot(self.spark, self.snapshot):
            changed = cut(hash_diff(self.section("files").select("file", "sha256"), files.select("file", "sha256")))
            if changed.isEmpty():
                return {"built": False, "changed": []}
            names = [r.file for r in changed.orderBy("file").limit(REPORTED).collect()]
            fresh = read_matches(files.join(changed.where("change <> 'deleted'").select("file"), "file", "left_semi"))
            matches = apply_update(self.section("matches"), fresh, changed)
        else:
            matches = read_matches(files)
        matches = cut(matches)
        graph = B.build(files, matches)
        tables = {n: getattr(graph, n) for n in SECTIONS if n not in ("files", "matches")} | {"files": files.drop("mtime"), "matches": matches}
        return {"built": True, "changed": names, "version": records.save_snapshot(tables, self.snapshot)}

    def watch(self, rounds: int | None = None, interval: float = 1.0) -> Iterator[dict]:
        """Builds again whenever files appear, change or go, looking every `interval` seconds; gives the answer of each build. rounds: how often to look (None: for ever)."""
        done = 0
        while rounds is None or done < rounds:
            if done:
                time.sleep(interval)
            done += 1
            if (answer := self.build_graph())["built"]:
                yield answer

    def merge_trace(self, path: str, tests: int = 5) -> DataFrame:
        """The function calls of the graph with what a recorded trace saw: counts, the first tests, confidence. What was recorded of files that changed since doesn't count; pairs without an edge are added."""
        seen, recorded = records.load_trace(self.spark, path)
        seen = records.stale_edges(seen, recorded, self.section("files").select("file", "sha256"))
        ends = [f"{side}_{part}" for side in ("src", "dst") for part in ("file", "function", "class")]
        e = self.section("execution_edges").where("edge_type = 'FUNCTION_CALL'")
        flat = e.select(*[F.coalesce(F.col(c.replace("_", ".", 1)), F.lit("")).alias(c) for c in ends], "confidence").groupBy(*ends).agg(F.min("confidence").alias("confidence"))
        trace = seen.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ends], "test", "count", "stale")
        return merge_trace(flat, trace, ends, F.col("stale"), tests)

    def section(self, name: str) -> DataFrame:
        return records.load_snapshot(self.spark, self.snapshot, name)

    def graph(self) -> B.Graph:
        return B.Graph({n: self.section(n) for n in SECTIONS if n != "matches"})

    def target(self, *specs: str) -> DataFrame:
        """seed_id, node of target specs; an ambiguous or unknown one is an error with candidates."""
        found = [Y.resolve_target(self.section("functions"), s) for s in specs]
        rows = [[i, t["type"], *[t.get(k) for k in ("file", "function", "class", "route", "method")]] for i, t in enumerate(found)]
        raw = self.spark.createDataFrame(rows, "seed_id bigint, type string, file string, function string, cls string, route string, method string")
        return raw.select("seed_id", node(F.col("type"), file=F.col("file"), function=F.col("function"), class_=F.col("cls"), route=F.col("route"), method=F.col("method")).alias("node"))

    def impact(self, spec: str, policy: str = "DEFAULT", max_depth: int | None = None, direction: str | None = None, include_tests: bool = False, min_confidence: str | None = None) -> dict:
        target, edges = self.target(spec), self.section("execution_edges")
        if policy == "DEPENDENCY_ONLY":  # between files: that of the target
            edges = edges.unionByName(B.import_edges(self.section("imports")))
            target = target.select("seed_id", node("FILE", file=F.col("node.file")).alias("node"))
        rows = I.resolve_impact(edges, target, policy, max_depth, direction, None, include_tests, min_confidence).orderBy("direction", "depth", "edge_id").collect()
        name = spec.rsplit(":", 1)[-1].rsplit(".", 1)[-1]
        calls = self.section("calls").select("file", "function", "resolved_file", "external")
        whole = I.completeness(calls, self.spark.createDataFrame([(0, name)], "seed_id bigint, name string")).first()
        return {way: [r.asDict(True) for r in rows if r.direction == key] for way, key in (("upstream", "up"), ("downstream", "down"))} | {"completeness": whole.asDict()}

    def neighbors(self, spec: str, hops: int = 1, include_tests: bool = False, limit: int = 40) -> list[dict]:
        return [r.asDict() for r in I.neighbors(self.section("execution_edges"), self.target(spec), hops, include_tests, limit).collect()]

    def tests_for(self, spec: str, hops: int = 3, limit: int = 30) -> list[dict]:
        """Tests that reach a target; where none does, test files that depend on its file."""
        target = self.target(spec)
        files = self.section("functions").where("is_test").select("file")
        rows = [r.asDict() for r in I.tests_for(self.section("execution_edges"), target, files, hops, limit).collect()]
        if rows:
            return rows
        file = target.first().node.file
        return [r for r in self.file_dependents(file, hops, limit) if r["is_test"]] if file else []

    def file_dependents(self, file: str, hops: int = 2, limit: int = 60) -> list[dict]:
        links = self.section("imports").select("file", "resolved_file", "is_test").unionByName(self.section("reexports").select("file", "resolved_file", F.lit(False).alias("is_test")))
        return [r.asDict() for r in I.file_dependents(links, self.spark.createDataFrame([(file,)], "file string"), hops, limit).orderBy("is_test", "depth", "file").collect()]

    def find_symbols(self, query: str, limit: int = 10, include_tests: bool = False) -> list[dict]:
        """Files ranked against a free text (symbols.rank_files), with the matching symbols and texts of symbols.find_symbols as reasons."""
        f = self.section("functions")
        f = (f if include_tests else f.where("not is_test")).select("file", "name", "class")
        texts = Y.literals(self.section("literals")).select("file", "text")
        why = {r.file: list(r.reasons) for r in Y.find_symbols(f, query, texts, 4 * limit).collect()}
        return [r.asDict() | {"reasons": why.get(r.file, [])} for r in Y.rank_files(f, query, texts, limit, include_tests).collect()]

    def query_context(self, *specs: str, policy: str = "DEFAULT") -> list[dict]:
        g = self.graph()
        return [r.asDict(True) for r in X.assemble(g.execution_edges, self.target(*specs), g.functions, g.files, g.security_findings, policy).collect()]

    def skeleton(self, file: str, max_symbols: int = 60) -> list[dict]:
        return [r.asDict() for r in Y.skeleton(self.section("functions"), self.spark.createDataFrame([(file,)], "file string"), max_symbols).orderBy("nth").collect()]

    def expand(self, file: str, function: str) -> list[str]:
        return [r.code for r in X.signature(self.section("files"), self.section("functions"), file, function).collect()]

    def routes(self) -> list[dict]:
        return [r.asDict() for r in self.section("routes").orderBy("path", "method").collect()]

    def metrics(self) -> dict[str, int]:
        named = {n: self.section(n) for n in ("functions", "imports", "calls", "routes", "execution_edges", "taint_sources", "security_findings")}
        return {r.section: r.n for r in I.graph_metrics(**named).collect()}


def main(argv: list[str] | None = None) -> None:
    from .session import local_session

    args = argparse.ArgumentParser(description="Impact and context of a source tree")
    args.add_argument("--dir", required=True)
    args.add_argument("--snapshot", required=True)
    args.add_argument("--build", action="store_true", help="build even if nothing changed")
    args.add_argument("--target")
    args.add_argument("--policy", default="DEFAULT", choices=sorted(I.POLICIES))
    args.add_argument("--show-code", action="store_true")
    args.add_argument("--out")
    args.add_argument("--serve", type=int, metavar="PORT", help="answer requests over HTTP after the build")
    given = args.parse_args(argv)
    engine = Engine(local_session(), given.dir, given.snapshot)
    answer: dict = {"graph": engine.build_graph(given.build), "metrics": engine.metrics()}
    if given.serve:
        from .server import serve

        serve(engine, given.serve).serve_forever()
    if given.target:
        answer["impact"] = engine.impact(given.target, given.policy)
        if given.show_code:
            answer["context"] = engine.query_context(given.target, policy=given.policy)
    text = json.dumps(answer, indent=1, default=str)
    if given.out:
        with open(given.out, "w") as out:
            out.write(text)
    else:
        print(text)


if __name__ == "__main__":
    main()
