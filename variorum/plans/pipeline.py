"""The whole run: ingest, families, dates, metrics, validation, gates, reports, export.

One object computes each stage once and hands it on.  Gates stand before publication: if a known
phenomenon isn't recovered, nothing is exported.
"""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import Settings
from ..operators import coherence as C
from ..operators import trees
from ..sources import files, tei
from . import analysis as A
from . import export as E
from . import figures as V
from . import genealogy as G
from . import metrics as M


class Pipeline:
    """Stages over a store folder.  ``fast`` draws fewer resamples."""

    def __init__(self, spark: SparkSession, store: str, settings: Settings = Settings(), fast: bool = False):
        self.spark, self.store = spark, store
        self.settings = replace(settings, genealogy_bootstrap=8, robustness_bootstrap=80) if fast else settings
        self.collation: schema.Collation | None = None
        self.genealogy: G.Genealogy | None = None

    def ingest(self, apparatus: str, name: str = "*.xml") -> schema.Collation:
        """Parse the apparatus into the store, and read it from there."""
        schema.save(tei.read_apparatus(self.spark, apparatus, self.settings, name), self.store)
        return self.open()

    def open(self, with_witnesses: bool = False) -> schema.Collation:
        self.collation = schema.load(self.spark, self.store, self.settings, with_witnesses)
        return self.collation

    def families(self, dates: DataFrame | None = None, known: dict = G.KNOWN) -> DataFrame:
        """Witnesses with family, weight and dates (dates always follow families, which replace the table)."""
        self.genealogy = G.from_collation(self.collation)
        witnesses = G.families(self.genealogy, self.settings.n_clusters, known)
        if dates is not None:
            witnesses = M.enrich_dates(witnesses, dates)
        for name, kind in (("docid", "int"), ("date_early", "int"), ("date_late", "int"), ("date_mid", "int")):
            if name not in witnesses.columns:
                witnesses = witnesses.withColumn(name, F.lit(None).cast(kind))
        stored = schema.save_metric(witnesses.select(*schema.WITNESSES.names), self.store, "witness_metadata")
        self.collation = self.collation.with_witnesses(stored)
        return stored

    def metrics(self) -> dict[str, DataFrame]:
        """All metric tables, stored."""
        c, save = self.collation, lambda name, df: schema.save_metric(df, self.store, name)
        unit = save("metrics_unit", M.unit_instability(c))
        verse = save("metrics_verse", M.verse_metrics(c, unit))
        chapter = save("metrics_chapter", M.chapter_metrics(c, verse))
        vote = save("metrics_unit_family", M.family_vote(c))
        consensus = save("metrics_unit_consensus", M.unit_stability(c))
        return {
            "metrics_unit": unit, "metrics_verse": verse, "metrics_chapter": chapter, "metrics_unit_family": vote, "metrics_unit_consensus": consensus,
            "metrics_chapter_family": save("metrics_chapter_family", M.chapter_comparison(c, vote, chapter)),
            "metrics_verse_stability": save("metrics_verse_stability", M.verse_stability(c, consensus)),
            "witness_family": save("witness_family", G.clusters(self.genealogy, self.settings.n_clusters)),
            "witness_distance": save("witness_distance", self.genealogy.pairs),
        }

    def check(self, cores: dict[str, list[str]] = G.CORES) -> dict:
        """The three release gates' results; raises if one fails."""
        c, s = self.collation, self.settings
        found = {"interpolation": A.interpolation_gate(c, s.gate_permutations), "dates": A.date_signal(c), "monophyly": trees.monophyly(self.genealogy.tree, cores, s.monophyly_purity, s.clade_compactness)}
        A.release_gates(found["interpolation"], found["dates"], found["monophyly"], s.alpha)
        return found

    def validate(self, bundle: DataFrame | None = None, b: int | None = None) -> dict:
        """How far the families may be trusted: silhouettes, clade support, neighbours, cuts, other thresholds."""
        matrix = C.reading_matrix(self.collation)
        truth = G.ground_truth(matrix.select("base_ga").distinct(), bundle)
        return G.validate(self.genealogy, matrix, truth, self.settings, b)

    def style(self, books: dict[str, tuple[str, DataFrame]], target: str, n_perm: int | None = None) -> dict:
        """Stylometry of a book's sections; ``books``: name -> (author, lemmas)."""
        return A.style(books, target, self.settings, n_perm)

    def publish_validation(self, found: dict, folder: str) -> Path:
        return E.report(Path(folder) / "genealogy" / "VALIDATION.md", "Genealogy validation", G.validation_report(found))

    def publish_style(self, found: dict, folder: str) -> Path:
        parts = {
            "Method": {"windows of": self.settings.window, "most frequent words": self.settings.n_mfw, "same author": found["same_author"], "different authors": found["diff_author"], "separates authors": found["separates"]},
            "Sections against the body": found["sections"].orderBy("section"),
            "Tests": found["tests"].orderBy("section"),
        }
        return E.report(Path(folder) / "reports" / "STYLOMETRY.md", "Stylometry", parts)

    def figures(self, folder: str) -> list[Path]:
        """The chapters' instability by both ways of counting, and the tree of witnesses."""
        c, out = self.collation, Path(folder) / "figures"
        families = {r["base_ga"]: r["family"] for r in c.witnesses.select("base_ga", "family").collect()}  # witnesses
        lines = {"flat_instability": "one vote a witness", "family_instability": "one vote a family", "between_family_split": "families disagree"}
        return [V.line_chart(M.chapter_comparison(c), "chapter", lines, out / "chapters.svg", f"{c.settings.title}: instability by chapter"), V.dendrogram(self.genealogy.tree, out / "tree.svg", families)]

    def publish(self, folder: str, gates: dict, english: DataFrame | None = None, links: DataFrame | None = None) -> Path:
        """Reports, trees, heatmap and site data."""
        out, c, g = Path(folder), self.collation, self.genealogy
        homogeneity = {r["family"]: round(r["homogeneity"], 3) for r in C.homogeneity(g.pairs, c.witnesses).collect() if r["family"] != "other"}
        made = [E.nexus_distances(g.pairs, out / "genealogy" / "witnesses.nex"), E.nexus_characters(g.matrix, out / "genealogy" / "characters.nex"), E.newick(g.pairs, out / "genealogy" / "nj.nwk")]
        E.stability_report(c, out / "reports" / "STABILITY.md", homogeneity)
        E.report(out / "reports" / "GENEALOGY.md", "Genealogy", {"Monophyly": gates["monophyly"], "Homogeneity": homogeneity})
        E.report(out / "reports" / "CONFOUNDS.md", "Confounds", {"Fit": (fit := A.confounds(c)), "Coefficients": fit["coefficients"]})
        E.report(out / "reports" / "ROBUSTNESS.md", "Robustness", {"Result": (r := A.robustness(c)), "Chapter intervals": r["chapter_ci"].orderBy("chapter")})
        E.report(out / "reports" / "REPORT.md", "Findings", {"Store": M.store_summary(c), "Interpolation": gates["interpolation"], "Dates": gates["dates"], "Chapters": M.chapter_comparison(c).orderBy("chapter")})
        E.heatmap(c, out / "reports" / "heatmap.html")
        E.export_site(c, out / "data", {k: str(v) for k, v in gates.items()}, homogeneity, english, links)
        E.copy_artifacts(made, out / "assets")
        return out

    def run(
        self, apparatus: str, out: str, dates_csv: str | None = None, links_json: str | None = None, english_json: str | None = None, bundle: str | None = None, books: dict[str, tuple[str, str]] | None = None, target: str = "john"
    ) -> Path:
        """``bundle``: a folder of files named by the Byzantine witnesses; ``books``: name -> (author, lemma file)."""
        self.ingest(apparatus)
        self.families(files.read_dates(self.spark, dates_csv) if dates_csv else None)
        self.metrics()
        gates = self.check()
        self.publish_validation(self.validate(files.read_bundle(self.spark, bundle) if bundle else None), out)
        if books:
            self.publish_style(self.style({n: (author, files.read_lemmas(self.spark, path)) for n, (author, path) in books.items()}, target), out)
        self.figures(out)
        return self.publish(out, gates, files.read_translation(self.spark, english_json) if english_json else None, files.read_links(self.spark, links_json) if links_json else None)


def main(argv: list[str] | None = None) -> None:
    import argparse

    from ..config import load

    p = argparse.ArgumentParser(prog="variorum")
    p.add_argument("apparatus")
    p.add_argument("store")
    p.add_argument("out")
    p.add_argument("--config")
    p.add_argument("--dates")
    p.add_argument("--links")
    p.add_argument("--english")
    p.add_argument("--bundle")
    p.add_argument("--book", action="append", default=[], metavar="NAME:AUTHOR:FILE", help="lemmatised text for stylometry (repeat)")
    p.add_argument("--target", default="john", help="the book whose sections are compared")
    p.add_argument("--fast", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("variorum").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    books = {n: (author, path) for n, author, path in (b.split(":", 2) for b in a.book)}
    Pipeline(spark, a.store, load(a.config), a.fast).run(a.apparatus, a.out, a.dates, a.links, a.english, a.bundle, books or None, a.target)


if __name__ == "__main__":
    main()
