import json

import pytest

from variorum import schema
from variorum.config import Settings, load
from variorum.operators import coherence as C
from variorum.plans import analysis as A
from variorum.plans import export as E
from variorum.plans import genealogy as G
from variorum.plans import metrics as M
from variorum.plans.pipeline import Pipeline
from variorum.sources import files, tei
from variorum.streaming.ingest import ingest_new

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<app n="B04K1V1" from="2" to="4"><lem wit="basetext">alpha beta</lem>
<rdg n="a" wit="01 03* P66 basetext">alpha <hi>be</hi>ta<wit><idno>01</idno></wit></rdg>
<rdg n="b" varSeq="2" wit="01C L5">alpha <hi>ga</hi>mma</rdg>
<rdg n="c" type="om" wit="13"/></app>
<app n="B04K1V1" type="lac"><rdg n="z" type="lac" wit="04"/></app>
</body></text></TEI>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("tei")
    (d / "chapter_1.xml").write_text(TEI, encoding="utf-8")
    return d


def test_tei(spark, folder, tmp_path):
    c = tei.read_apparatus(spark, str(folder))
    units = {r["app_id"]: r for r in c.units.collect()}
    assert set(units) == {"B04K1V1/2-4", "B04K1V1/_-_"} and units["B04K1V1/2-4"]["n_readings"] == 3
    assert units["B04K1V1/_-_"]["app_type"] == "lac" and units["B04K1V1/_-_"]["app_from"] is None
    readings = {r["reading_id"]: r for r in c.readings.collect()}
    assert readings["a"]["reading_text"] == "alpha beta" and readings["a"]["is_lemma"]
    assert readings["b"]["reading_text"] == "alpha gamma" and not readings["c"]["is_lemma"]
    att = {(r["witness_raw"], r["base_ga"], r["hand"]) for r in c.attestation.collect()}
    assert ("01C", "01", "corrector") in att and ("03*", "03", "firsthand") in att and len(att) == 8
    schema.save(c, str(tmp_path / "store"))
    again = schema.load(spark, str(tmp_path / "store"), with_witnesses=False)
    assert again.attestation.count() == 8 and M.store_summary(again).first()["units_lac"] == 1
    with pytest.raises(FileNotFoundError):
        tei.read_apparatus(spark, str(folder), name="*.none")


def test_streaming_ingest_takes_each_file_once(spark, folder, tmp_path):
    for _ in range(2):
        ingest_new(spark, str(folder), str(tmp_path / "s"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "s" / "attestation.parquet")).count() == 8


def test_small_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("manuscripts.manuscript.docID,manuscripts.manuscript.orig\n30001.0,XII\nx,I\n30001,XIII\n20001,IV\n")
    assert {(r["docid"], r["orig"]) for r in files.read_dates(spark, str(tmp_path / "d.csv")).collect()} == {(30001, "XIII"), (20001, "IV")}
    (tmp_path / "t.txt").write_text("010203 N- ---- a b c lemma\nshort line\n010204 V- x y z w zwei\n")
    assert [tuple(r)[1:] for r in files.read_lemmas(spark, str(tmp_path / "t.txt")).orderBy("line").collect()] == [(2, 3, "N-", "lemma"), (2, 4, "V-", "zwei")]
    (tmp_path / "l.json").write_text(json.dumps({"source": "s", "url_template": "u/{ga}", "available": ["01", "03"]}, indent=1))
    assert files.read_links(spark, str(tmp_path / "l.json")).count() == 2 and files.read_links(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"verses": {"B04K1V1": "In the"}}))
    assert files.read_translation(spark, str(tmp_path / "e.json")).first()["english"] == "In the"
    names = spark.createDataFrame([("a/04_041.xml",), ("04_18S1.xml",), ("04_K994.xml",), ("04_L704.xml",)], "n string")
    assert {r[0] for r in names.select(files.bundle_siglum("n")).collect()} == {"041", "18", None, "L704"}
    (tmp_path / "c.yaml").write_text("seed: 5\ngenealogy:\n  min_units: 7\nvalidation:\n  known_interpolations: [B04K5V4]\n")
    assert load(str(tmp_path / "c.yaml")).min_units == 7 and load(str(tmp_path / "c.yaml")).interpolations == ("B04K5V4",)


def _collation(spark):
    """Three groups of witnesses over 40 units of two chapters."""
    groups = {"A": ["1", "2", "3"], "B": ["13", "14", "15"], "C": ["01", "02", "03"]}
    units = spark.createDataFrame([(f"u{i:02d}", "B04", 1 + i // 20, i % 20 + 1, f"B04K{1 + i // 20}V{i % 20 + 1}", i * 2, i * 2, "main", f"w{i}") for i in range(40)], "app_id string, book string, chapter int, verse int, verse_id string, app_from int, app_to int, app_type string, lemma_text string")
    readings = spark.createDataFrame([(f"u{i:02d}", r, None, r, r == "a") for i in range(40) for r in "abc"], "app_id string, reading_id string, reading_type string, reading_text string, is_lemma boolean")
    pick = lambda g, i: "abc"[("ABC".index(g) * (i % 3)) % 3]
    att = [(f"u{i:02d}", pick(g, i) if (n + i) % 7 else "a", w, "firsthand") for i in range(40) for g, ws in groups.items() for n, w in enumerate(ws) if not (20 <= i < 22 and g == "C")]
    wit = spark.createDataFrame([(w, g, 100 + 300 * n) for g, ws in groups.items() for n, w in enumerate(ws)], "base_ga string, family string, date_mid int")
    return schema.Collation(units, readings, spark.createDataFrame(att, "app_id string, reading_id string, base_ga string, hand string"), wit, Settings(min_units=5, min_extant=5, min_overlap=5, n_clusters=3))


def test_exports(spark, tmp_path):
    c = _collation(spark)
    g = G.from_collation(c)
    assert len({frozenset(r["base_ga"] for r in rows) for rows in [G.clusters(g, 3).collect()]}) == 1 and g.tree.size[-1] == 9
    E.nexus_distances(g.pairs, tmp_path / "d.nex")
    E.nexus_characters(g.matrix, tmp_path / "c.nex")
    E.newick(g.pairs, tmp_path / "t.nwk")
    back = {(r["w1"], r["w2"]): r["distance"] for r in files.read_nexus_distances(spark, str(tmp_path / "d.nex")).collect()}
    own = {(r["w1"], r["w2"]): round(r["distance"], 4) for r in g.pairs.collect()}
    assert back == pytest.approx(own, abs=1e-4) and len(back) == 36
    chars = files.read_nexus_characters(spark, str(tmp_path / "c.nex"))
    again = {(r["w1"], r["w2"]): r["distance"] for r in C.distances(chars, 5).collect()}
    assert again == pytest.approx({(r["w1"], r["w2"]): r["distance"] for r in g.pairs.collect()})
    a, b = E.export_site(c, tmp_path / "a"), E.export_site(c, tmp_path / "b")
    names = sorted(p.relative_to(a) for p in a.rglob("*.json"))
    assert len(names) == 5 and all((a / n).read_bytes() == (b / n).read_bytes() for n in names)
    doc = json.loads((a / "chapters" / "1.json").read_text())
    assert [v["verse"] for v in doc["verses"]] == list(range(1, 21)) and doc["verses"][1]["units"][0]["readings"][0]["families"]
    page = E.heatmap(c, tmp_path / "h.html").read_text()
    assert "http" not in page and '"1:1":' in page
    assert "Most stable" in E.stability_report(c, tmp_path / "s.md").read_text()


def test_gates_and_models(spark, tmp_path):
    c = _collation(spark).with_settings(pericope=("B04K2V1", "B04K2V2"), interpolations=("B04K2V1",), robustness_bootstrap=20)
    gate = A.interpolation_gate(c, 50)
    assert gate["pericope_adulterae"]["difference"] < 0 and gate["gate_passed"] and gate["pericope_adulterae"]["n_windows"] == 39
    with pytest.raises(A.GateError, match="dates"):
        A.release_gates(gate, {"omitters_earlier": False}, {"all_passed": True}, 0.05)
    fit = A.confounds(c)
    assert fit["n"] == 40 and fit["coefficients"].count() == 6
    assert A.robustness(c, 20, ("A", "B", "C"))["chapter_ci"].count() == 2
    assert G.bootstrap_support(G.from_collation(c), {"A": ["1", "2", "3"]}, 4, 1, 5).first()["support"] >= 0
    p = Pipeline(spark, str(tmp_path / "store"), c.settings, fast=True)
    assert p.settings.genealogy_bootstrap == 8
