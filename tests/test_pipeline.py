"""The whole run over a small TEI apparatus, and stylometry over invented books."""

import random

import pytest

from variorum.config import Settings
from variorum.operators import stylometry as Y
from variorum.plans import analysis as A
from variorum.plans.pipeline import Pipeline

GROUPS = {"f1": ["1", "1582", "118", "209"], "f13": ["13", "69", "124", "346"], "rest": ["01", "03", "P66", "P75", "33", "579"]}


def apparatus():
    rng = random.Random(1)
    apps = []
    for verse in range(1, 31):
        for slot in (2, 4):
            seen = {"a": [], "b": [], "c": []}
            for group, members in GROUPS.items():
                own = rng.choice("abc")
                for w in members:
                    if verse in (4,) and group == "rest":
                        continue  # they lack the passage
                    seen[own if rng.random() < 0.9 else rng.choice("abc")].append(w)
            rdg = "".join(f'<rdg n="{k}" wit="{" ".join(v)}">{"word" if k == "a" else "other " + k}</rdg>' for k, v in seen.items())
            apps.append(f'<app n="B04K5V{verse}" from="{slot}" to="{slot}"><lem wit="basetext">word</lem>{rdg}</app>')
    return '<TEI xmlns="http://www.tei-c.org/ns/1.0">' + "".join(apps) + "</TEI>"


def test_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "chapter_5.xml").write_text(apparatus(), encoding="utf-8")
    rows = ["manuscripts.manuscript.docID,manuscripts.manuscript.orig"]
    for group, members in GROUPS.items():
        for i, w in enumerate(members):
            n = 10000 + int(w[1:]) if w[0] == "P" else 20000 + int(w) if w[0] == "0" else 30000 + int(w)
            rows.append(f"{n},{['II', 'III', 'IV', 'V', 'III', 'IV'][i] if group == 'rest' else ['X', 'XI', 'XII', 'XIV'][i]}")
    (tmp_path / "dates.csv").write_text("\n".join(rows))
    s = Settings(min_units=5, min_extant=5, min_overlap=5, n_clusters=3, pericope=("B04K5V4",), gate_permutations=50, n_permutations=100, robustness_bootstrap=10, clade_compactness=0.4)
    p = Pipeline(spark, str(tmp_path / "store"), s)
    from variorum.sources import files

    p.ingest(str(tmp_path / "in"))
    w = {r["base_ga"]: r for r in p.families(files.read_dates(spark, str(tmp_path / "dates.csv"))).collect()}
    assert w["1"]["family"] == "f1" and w["P66"]["family"] == "Alexandrian" and w["01"]["date_mid"] == 149
    tables = p.metrics()
    assert tables["metrics_unit"].count() == 60 and tables["witness_distance"].count() == 14 * 13 // 2
    gates = p.check()
    assert gates["interpolation"]["gate_passed"] and gates["dates"]["omitters_earlier"]
    out = p.publish(str(tmp_path / "out"), gates)
    assert {f.name for f in (out / "assets").iterdir()} == {"witnesses.nex", "characters.nex", "nj.nwk"}
    assert len(list((out / "reports").iterdir())) == 6 and (out / "data" / "chapters" / "5.json").exists()


def test_validation_style_and_figures(spark, tmp_path, books):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "chapter_5.xml").write_text(apparatus(), encoding="utf-8")
    s = Settings(min_units=5, min_extant=5, min_overlap=5, n_clusters=3, clade_compactness=0.4, genealogy_bootstrap=3, validation_k_max=6, window=20, n_mfw=5)
    p = Pipeline(spark, str(tmp_path / "store"), s)
    p.ingest(str(tmp_path / "in"))
    p.families()
    p.metrics()
    bundle = spark.createDataFrame([("33",), ("579",)], "base_ga string")
    found = p.validate(bundle)
    assert found["n_witnesses"] == 14 and set(found["bootstrap_support"]) == {"f1_core", "f13", "f1_full", "Byz"} and len(found["sensitivity"]) == 9
    assert {"f1", "f13", "Alexandrian", "Byz"} == set(found["silhouette"]["by_family"]) and -1 <= found["cluster_match"]["ari"] <= 1 and len(found["known_pairs"]["P75"]) == 2
    text = p.publish_validation(found, str(tmp_path / "out")).read_text()
    assert "## Clade support" in text and "f1_core" in text and "| max_modal |" in text
    style = p.publish_style(p.style(books, "J", 100), str(tmp_path / "out")).read_text()
    assert "## Sections against the body" in style and "farewell" in style
    assert [f.name for f in p.figures(str(tmp_path / "out"))] == ["chapters.svg", "tree.svg"]


@pytest.fixture(scope="module")
def books(spark):
    rng = random.Random(2)
    styles = {"X": [5, 1, 1, 2, 4], "Z": [1, 5, 4, 1, 1]}
    out = {}
    for book, author in (("A1", "X"), ("A2", "X"), ("B1", "Z"), ("J", "X")):
        rows = []
        for i in range(600):
            chapter = 1 + i // 28
            weights = styles["Z"] if book == "J" and 13 <= chapter <= 17 else styles[author]
            rows.append((i, min(chapter, 21), i % 28 + 1, rng.choices("vwxyz", weights)[0]))
        out[book] = (author, spark.createDataFrame(rows, "line int, chapter int, verse int, lemma string"))
    return out


def test_style(spark, books):
    got = A.style(books, "J", Settings(window=20, n_mfw=5), 200)
    assert got["separates"] and got["same_author"] < got["diff_author"]
    tests = {r["section"]: r for r in got["tests"].collect()}
    assert tests["farewell"]["p_fdr"] < 0.05 < tests["prologue"]["p"]
    labels = {r["section"]: r["label"] for r in got["sections"].collect()}
    assert labels["prologue"] == "within body range"


def test_windows_do_not_depend_on_documents(spark):
    words = [f"w{i}" for i in range(47)]
    a = spark.createDataFrame([("b", 0, " ".join(words))], "book string, doc_id int, text string")
    b = spark.createDataFrame([("b", i, " ".join(words[i * 5 : i * 5 + 5])) for i in range(10)], "book string, doc_id int, text string")
    rows = [sorted((r["window"], r["pos"], r["lemma"]) for r in Y.token_windows(x, ("book",), 10).collect()) for x in (a, b)]
    assert rows[0] == rows[1] and len(rows[0]) == 40
    assert len(Y.token_windows(a, ("book",), 9).collect()) == 45 and len(Y.token_windows(a, ("book",), 24).collect()) == 47
