"""Sinks: JSON documents, NEXUS, Newick, a self-contained heatmap, Markdown reports.

Documents are assembled by Spark as nested rows for all chapters at once; the driver writes the
finished strings of published size (one file a chapter).
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coherence as C
from ..operators import trees
from ..operators.statistics import numbered
from ..schema import Collation
from . import metrics as M

#: Fixed value: the state symbols of standard character data.
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_JSON = {"ignoreNullFields": "false"}


def _put(path: Path, text: str) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def json_rows(df: DataFrame, order: list[str]) -> str:
    """A JSON array of the rows in order, compact, with nulls."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*df.columns), _JSON).alias("j")).toLocalIterator()
    return "[" + ",".join(r["j"] for r in rows) + "]"


def chapter_documents(c: Collation, english: DataFrame | None = None) -> DataFrame:
    """(chapter, doc): the drill-down of each chapter as one JSON string."""
    units = M.unit_drilldown(c)
    named = F.transform("readings", lambda r: r.withField("families", F.map_from_entries(F.coalesce(r["families"], F.array().cast("array<struct<family:string,n:bigint>>")))))
    verses = M.verse_drilldown(c, english, units.withColumn("readings", named))
    one = F.struct("verse", "verse_id", "ref", "text", "english", "slots", "units", "whole_verse", "n_units_total", "n_variation_units")
    # maps have no order, so the verses of a chapter are ordered by number and looked up by it
    each = verses.select("chapter", "verse", F.to_json(one, _JSON).alias("j"))
    listed = each.groupBy("chapter").agg(F.sort_array(F.collect_list(F.struct("verse", "j"))).alias("v"))
    doc = F.concat(F.lit('{"chapter":'), F.col("chapter").cast("string"), F.lit(',"verses":['), F.array_join(F.transform("v", lambda x: x["j"]), ","), F.lit("]}"))
    return listed.select("chapter", doc.alias("doc"))


def witness_list(c: Collation, links: DataFrame | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Witnesses with family, dates, name and link."""
    w = c.witnesses
    for column in ("date_early", "date_late", "date_mid"):
        if column not in w.columns:
            w = w.withColumn(column, F.lit(None).cast("int"))
    out = w.select(F.col("base_ga").alias("ga"), "family", "date_early", "date_late", "date_mid")
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    out = out.withColumn("name", F.try_element_at(known, F.col("ga")) if known is not None else F.lit(None).cast("string"))
    if links is None:
        return out.withColumn("url", F.lit(None).cast("string"))
    return out.join(links, "ga", "left").withColumn("url", F.replace("url_template", F.lit("{ga}"), F.col("ga"))).drop("url_template")


def export_site(c: Collation, folder: str | Path, gates: dict | None = None, homogeneity: dict[str, float] | None = None, english: DataFrame | None = None, links: DataFrame | None = None, names: dict[str, str] | None = None) -> Path:
    """summary.json, verses.json, families.json and chapters/N.json; two exports are equal byte by byte."""
    out = Path(folder)
    index = M.verse_index(c).cache()
    rounded = {k: T.binary_round(k, 4) for k in ("instability", "stability", "family_stability", "anchor_frac", "family_instability", "between_family_split")} | {"eff_families": T.binary_round("eff_families", 2)}
    _put(out / "verses.json", json_rows(index.withColumns(rounded), ["chapter", "verse"]))
    sizes = c.witnesses.groupBy("family").agg(F.count("*").alias("n"), F.min("family_source" if "family_source" in c.witnesses.columns else F.lit(None).cast("string")).alias("source"))
    families = [dict(family=r["family"], n=r["n"], source=r["source"], homogeneity=(homogeneity or {}).get(r["family"])) for r in sizes.orderBy("family").collect()]
    witnesses = json.loads(json_rows(witness_list(c, links, names), ["family", "ga"]))
    dump = lambda name, doc: _put(out / name, json.dumps(doc, ensure_ascii=False, separators=(",", ":")))
    dump("families.json", {"families": families, "witnesses": witnesses})
    s = c.settings
    rule = f"flagged when a verse has ≤{s.low_confidence_max_early} early (≤{s.early_until} CE) witnesses, fewer than {s.low_confidence_min_families} families, or an effective family count below {s.low_confidence_min_eff_families}"
    chapters = M.chapter_summary(c)
    meta = M.corpus_summary(c, index).first().asDict() | {"confidence_rule": rule}
    dump("summary.json", {"meta": meta, "chapters": json.loads(json_rows(chapters.select([T.binary_round(f.name, 4).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in chapters.schema]), ["chapter"])), "families": families, "gates": gates, "translation": None if english is None else {"name": "World English Bible", "license": "Public Domain"}})
    for r in chapter_documents(c, english).orderBy("chapter").toLocalIterator():
        _put(out / "chapters" / f"{r['chapter']}.json", r["doc"])
    index.unpersist()
    return out


def copy_artifacts(files: Iterable[str | Path], folder: str | Path) -> list[Path]:
    """Those of the files that exist, copied into a folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    return [Path(shutil.copy(f, folder)) for f in files if Path(f).exists()]


def nexus_distances(pairs: DataFrame, path: str | Path) -> Path:
    """Taxa and the full distance matrix with four decimals."""
    names, d = trees.matrix(pairs)
    safe = [n.replace(" ", "_") for n in names]
    head = ["#NEXUS", "", "BEGIN taxa;", f"  DIMENSIONS ntax={len(safe)};", "  TAXLABELS " + " ".join(safe) + ";", "END;", "", "BEGIN distances;", "  FORMAT triangle=both diagonal labels;", "  MATRIX"]
    return _put(Path(path), "\n".join([*head, *[f"  {n} " + " ".join(f"{x:.4f}" for x in row) for n, row in zip(safe, d)], "  ;", "END;"]))


def character_rows(matrix: DataFrame, states: str = SYMBOLS) -> DataFrame:
    """(base_ga, sequence): a symbol for each unit in order, by the rank of the reading in its unit; '?' where
    a witness isn't extant.  Units with more readings than symbols are left out."""
    coded = C.codes(matrix)
    units = coded.groupBy("app_id").agg(F.max("code").alias("m")).filter(F.col("m") < len(states))
    # columns of the matrix: contested units, numbered in order
    units = numbered(units, "app_id").withColumn("at", F.col("at") + 1)
    width = units.agg(F.count("*").alias("width"))  # one row
    cells = coded.join(units, "app_id", "left").crossJoin(F.broadcast(width)).select("base_ga", "at", "width", F.substring(F.lit(states), F.col("code") + 1, F.lit(1)).alias("s"))
    rows = cells.groupBy("base_ga").agg(F.max("width").alias("width"), F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "s")))).alias("c"))
    # only the cells that are there are joined; what lies between them is filled in place
    gap = lambda n: F.repeat(F.lit("?"), n.cast("int"))
    filled = F.transform("c", lambda x, i: F.concat(gap(x["at"] - 1 - F.when(i > 0, F.get("c", i - 1)["at"]).otherwise(0)), x["s"]))
    last = F.when(F.size("c") > 0, F.get("c", F.size("c") - 1)["at"]).otherwise(0)
    return rows.select("base_ga", F.concat(F.array_join(filled, ""), gap(F.col("width") - last)).alias("sequence"))


def nexus_characters(matrix: DataFrame, path: str | Path) -> Path:
    rows = [(r["base_ga"].replace(" ", "_"), r["sequence"]) for r in character_rows(matrix).orderBy("base_ga").collect()]
    width = max((len(n) for n, _ in rows), default=0)
    body = "\n".join(f"  {n.ljust(width)}  {s}" for n, s in rows)
    return _put(Path(path), f"#NEXUS\n\nBEGIN data;\n  DIMENSIONS ntax={len(rows)} nchar={len(rows[0][1]) if rows else 0};\n  FORMAT datatype=Standard symbols=\"{SYMBOLS}\" gap=- missing=?;\n  MATRIX\n{body}\n  ;\nEND;\n")


def newick(pairs: DataFrame, path: str | Path) -> Path:
    names, d = trees.matrix(pairs)
    return _put(Path(path), trees.newick(trees.ladderize(trees.neighbor_joining([n.replace(" ", "_") for n in names], d))) + "\n")


def heatmap_data(c: Collation, verses: DataFrame | None = None) -> dict:
    """Cells {c:v: [stability, anchor %, units]} with the scale's floor (2nd percentile), mean and least verse."""
    rows = (M.verse_stability(c) if verses is None else verses).dropna(subset=["family_stability"]).cache()
    s = F.col("family_stability")
    floor = rows.agg(F.percentile(s, 0.02)).first()[0]
    marks = rows.agg(F.max(s).alias("high"), F.avg(s).alias("mean_value"), F.count("*").alias("cells_shown"), F.max("verse").alias("last_verse"), F.count_if(s < floor).alias("below_low"), F.min(F.struct(s, "chapter", "verse")).alias("least")).first()
    n = c.attestation.filter(F.col("base_ga") != c.settings.base_witness).agg(F.countDistinct("base_ga")).first()[0]
    cells = {f"{r['chapter']}:{r['verse']}": [round(r["family_stability"], 4), round(r["anchor_frac"] * 100), r["n_units"]] for r in rows.orderBy("chapter", "verse").toLocalIterator()}
    rows.unpersist()
    return {"cells": cells, "low": floor, "witnesses": n} | marks.asDict(recursive=True)


_PAGE = """<!doctype html><meta charset="utf-8"><title>Stability</title>
<style>body{{font:14px sans-serif}}td{{width:10px;height:10px}}</style>
<p>{cells_shown} verses, {witnesses} witnesses, mean {mean_value:.3f}; scale from {low:.3f} to {high:.3f} ({below_low} below)</p><table id="t"></table>
<script>const d={data},lo={low},hi={high},t=document.getElementById("t"),rows={{}};
for(const k in d){{const [c,v]=k.split(":");(rows[c]??=[])[v-1]=d[k]}}
for(const c in rows){{const r=t.insertRow();r.insertCell().textContent=c;for(let v=0;v<{last_verse};v++){{const x=rows[c][v],e=r.insertCell();
if(x){{const s=Math.max(0,Math.min(1,(x[0]-lo)/(hi-lo||1)));e.style.background=`hsl(${{120*s}} 60% 55%)`;e.title=`${{c}}:${{v+1}} ${{x[0]}}, ${{x[1]}}% anchors, ${{x[2]}} units`}}}}}}</script>
"""


def heatmap(c: Collation, path: str | Path, verses: DataFrame | None = None) -> Path:
    """The cells as one HTML page without external parts."""
    d = heatmap_data(c, verses)
    return _put(Path(path), _PAGE.format(data=json.dumps(d["cells"], separators=(",", ":")), **{k: d[k] for k in ("low", "high", "mean_value", "cells_shown", "witnesses", "below_low", "last_verse")}))


def _table(rows: list[dict]) -> list[str]:
    if not rows:
        return ["(none)"]
    keys = list(rows[0])
    cell = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(keys) + " |", "|" + "--|" * len(keys), *["| " + " | ".join(cell(r[k]) for k in keys) + " |" for r in rows]]


def report(path: str | Path, title: str, parts: dict[str, object]) -> Path:
    """A Markdown report: a heading for each part; dicts and small frames become lists and tables."""
    lines = [f"# {title}"]
    for head, body in parts.items():
        lines += ["", f"## {head}"]
        if isinstance(body, DataFrame):
            lines += _table([r.asDict() for r in body.collect()])
        elif isinstance(body, list) and body and isinstance(body[0], dict):
            lines += _table(body)
        elif isinstance(body, dict):
            lines += [f"- {k}: {v}" for k, v in body.items() if not isinstance(v, DataFrame)]
        else:
            lines += [str(body)]
    return _put(Path(path), "\n".join(lines) + "\n")


def stability_report(c: Collation, path: str | Path, homogeneity: dict[str, float] | None = None) -> Path:
    verses = M.verse_stability(c).cache()
    by = verses.dropna(subset=["family_stability"]).groupBy("chapter").agg(F.avg("family_stability").alias("family_stability"), F.avg("stability").alias("stability"), F.avg("anchor_frac").alias("anchor_frac"))
    out = report(
        path, "Stability",
        {
            "Summary": M.anchor_summary(c).first().asDict(),
            "Most stable verses": M.ranked_verses(verses, "family_stability", 8, lowest=False).select("verse_id", "family_stability"),
            "Most fluid verses": M.ranked_verses(verses, "family_stability", 8).select("verse_id", "family_stability"),
            "Most stable chapters": by.orderBy(F.desc("family_stability"), "chapter").limit(5),
            "Least stable chapters": by.orderBy("family_stability", "chapter").limit(5),
            "Homogeneity of families": homogeneity or {},
        },
    )
    verses.unpersist()
    return out
