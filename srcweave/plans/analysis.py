"""The whole analysis of a table of files, from facts to posture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.operators import components as CO
from srcweave.operators import findings as FN
from srcweave.operators import graph as GR
from srcweave.operators import posture as PO
from srcweave.operators import reports as RP
from srcweave.operators import resolve as RS
from srcweave.operators import script_resolve as SS
from srcweave.operators import traversal as TV
from srcweave.operators.keys import by_key
from srcweave.operators.rules import RuleOptions
from srcweave.session import write_once
from srcweave.sources.python_facts import python_facts
from srcweave.sources.script_facts import script_facts


@dataclass(frozen=True)
class Analysis:
    """Result tables of one language."""

    parsed: DataFrame
    components: DataFrame
    relationships: DataFrame
    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame
    findings: DataFrame
    posture: DataFrame
    summary: DataFrame

    def cycle_steps(self) -> DataFrame:
        """An import cycle of each cyclic component, of any length, step by step; searched when called.

        ``id`` is the whole key of a file component, ``label`` its name.
        """
        return TV.cycle_witness(by_key(GR.import_subset(self.edges)), self._names())

    def cycles(self, max_length: int | None = None) -> DataFrame:
        """Import cycles with their whole path in a row: one of each cyclic component, of any length.

        With ``max_length`` instead all simple cycles of up to so many files.  :meth:`cycle_steps` has no rows
        that grow with a cycle.
        """
        if max_length is None:
            return TV.witness_paths(self.cycle_steps())
        return TV.short_cycles(by_key(GR.import_subset(self.edges)), max_length, self._names())

    def cyclic_components(self) -> DataFrame:
        return TV.cyclic_components(by_key(GR.import_subset(self.edges)))

    def _names(self) -> DataFrame:
        rows = self.components.where("type = 'file'")
        return rows.groupBy("project_id", F.col("key").alias("id")).agg(F.max("name").alias("label"))


def analyze(
    files: DataFrame, language: str, options: RuleOptions = RuleOptions(), reuse: bool = True
) -> Analysis:
    """Analyse a table of files of one language.

    With ``reuse`` the facts are written once to the shared folder, so each
    result reads columns instead of parsing again.
    """
    python = language == "python"
    parsed = python_facts(files) if python else script_facts(files)
    if reuse:
        parsed = write_once(parsed)
    comps = CO.components(parsed, language)
    rels = (
        RS.python_relationships(parsed, comps) if python
        else SS.script_relationships(parsed, comps)
    )
    found = FN.findings(parsed, language, options)
    projects = parsed.select("project_id").distinct()
    return Analysis(
        parsed=parsed,
        components=comps,
        relationships=rels,
        nodes=GR.graph_nodes(comps, rels),
        edges=GR.graph_edges(rels),
        clusters=GR.clusters(comps),
        findings=found,
        posture=PO.posture(found, projects, language),
        summary=RP.report_summary(comps, rels),
    )
