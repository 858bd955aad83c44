import math

import pytest
from pyspark.sql import functions as F

from kindred.operators import flatten, generate, graph
from kindred.operators import profile as P
from kindred.operators import weights as W
from kindred.sources import readers, writers


def values(spark, columns):
    rows = [(f"e{i}", p, float(v) if isinstance(v, (int, float)) else None, v if isinstance(v, str) else None) for p, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, P.VALUES)


def test_profile(spark):
    v = values(spark, {"num": [1, 2, 2, 9, 4], "cat": ["a", "b", "b", "c", None], "digits": ["1", "2", "3", "4", "x"], "mostly": ["1", "2", "3", "4", "5"]})
    got = {r["parameter"]: r for r in P.profile(v, 5).collect()}
    n = got["num"]
    assert (n["n"], n["coverage"], n["min"], n["max"], n["mean"], n["median"], n["n_unique"]) == (5, 100.0, 1.0, 9.0, 3.6, 2.0, 4)
    assert n["skew"] == 1.66 and n["iqr"] == 2.0
    c = got["cat"]
    assert (c["n"], c["coverage"], c["n_unique"], c["mode"], c["mode_count"]) == (4, 80.0, 3, "b", 2)
    assert (c["entropy"], c["entropy_max"]) == (1.5, 1.58)
    assert got["digits"]["datatype"] == P.CATEGORICAL  # four in five is not more than 0.8
    assert got["mostly"]["datatype"] == P.NUMERIC
    scored = {r["parameter"]: r["score"] for r in P.suitability(P.profile(v, 5), 5).collect()}
    want = 0.5 * math.log2(4) / math.log2(5) * 100 + 0.35 * n["cv"] + 0.15 * (100 - 1.66 * 33.33)
    assert scored["num"] == pytest.approx(round(want, 1))


def test_profile_of_nothing(spark):
    assert P.profile(values(spark, {"num": []}), 0).count() == 0


def test_mode_is_the_first_seen(spark):
    v = values(spark, {"c": ["b", "a", "a", "b", "x"]}).withColumn("ordinal", F.substring("entity_id", 2, 9).cast("long"))
    assert P.profile_categorical(v, 5).first()["mode"] == "b"
    assert P.profile_categorical(v.drop("ordinal"), 5).first()["mode"] == "a"


def test_report_and_export(spark, tmp_path):
    v = values(spark, {"num": [1, 2, 3], "cat": ["a", "b", "b"]})
    scored = P.suitability(P.profile(v, 3), 3)
    tables = P.report(scored)
    assert set(tables) == {"areas", "best", "worst", "varied", "categorical"}
    writers.write_profile(scored, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("﻿") and ";" in text and "–" in text and "2,0" in text


def test_clean(spark):
    rows = [("EdimWorkflow.a", 3, 50.0), ("SimocalcWorkflow.a", 3, 60.0), ("SimocalcWorkflow.b", 3, 10.0), ("constant", 1, 99.0), ("machine_id", 9, 98.0), ("known", 4, 20.0), ("copy", 4, 21.0), ("new", 4, 5.0)]
    scored = spark.createDataFrame(rows, "parameter string, n_unique long, score double")
    known = spark.createDataFrame([("known", "P_K", "C", "mm", "Geometrie", None, None), ("copy", "P_D", "C", "mm", "Geometrie", None, "known")], P.LABELS)
    new = spark.createDataFrame([("new", "P_N", "C", "kg", "Dynamik", "why", None), ("known", "P_X", "C", "kg", "Dynamik", "why", None)], P.LABELS)
    got = [(r["parameter"], r["relevance"], r["p_name"]) for r in P.clean(scored, known, new).collect()]
    assert got == [("known", P.KNOWN, "P_K"), ("new", P.NEW, "P_N"), ("EdimWorkflow.a", P.OTHER, "–"), ("SimocalcWorkflow.b", P.OTHER, "–")]
    assert [r["n"] for r in P.cleaning_counts(scored, known, new).collect()] == [8, 7, 6, 5, 4]


DOCUMENT = {
    "machine_id": "M1",
    "none": None,
    "empty": [],
    "one": [5],
    "flags": [True, False],
    "texts": ["a", "b"],
    "few": [{"x": 1}, {"x": 2}],
    "many": [{"x": 1}] * 4,
    "load": {"voltage": 7, "torque": 8.5},
    "RotorWorkflow": {"input": {"bearing_properties": {"zeta": {"d": 1}, "type": "ball", "alpha": {"d": 2}}}},
    "rotor": {
        "segments": [
            {"type": "shaft", "length": 1, "mass": "x", "description": "d", "parallel_key": {"b": 2, "c": None}, "function": ["g", "f"], "shoulder": {"left": {"r": 3}}},
            {"type": "shaft", "length": 3, "function": ["f"]},
            {"type": "fan", "length": 4},
        ]
    },
    "shaft_safety": {"output": [{"safety": {"fatigue_strength": 2, "yield_strength": 3}}, {"safety": {"fatigue_strength": 4}}]},
    "parallelkey_safety": {"output": [{"position": 1, "safety": {"key": {"s": 5}}}, {"position": 2}]},
    "roller_bearings": {"output": {"DE": [{"name": "n", "f": {"r": 6}}, {"name": "m"}]}},
}


def flat(spark, *documents):
    import json

    rows = spark.createDataFrame([(f"d{i}", json.dumps(x)) for i, x in enumerate(documents)], "name string, text string")
    out = [{} for _ in documents]
    for r in flatten.flatten_json(rows, F.col("text"), F.col("name")).orderBy("ordinal").collect():
        out[int(r["entity_id"][1:]) - 1][r["parameter"]] = r["value_str"] if r["value_num"] is None else r["value_num"]
    return out


def test_leaves_are_of_the_structure_alone():
    got = list(flatten.leaves({"a": {"b": 1, "c": None}, "d": [{"type": "t", "e": True}, {}], "f": [], "g": ["x", [2]]}))
    assert [(p, n, t) for p, n, t, _ in got] == [("a.b", 1, None), ("a.c", None, None), ("d[0].type", None, "t"), ("d[0].e", 1, None), ("d[1]", None, None), ("f", None, None), ("g[0]", None, "x"), ("g[1][0]", 2, None)]
    assert got[3][3] == (("d", 0, 2, "dicts", "t"),) and got[4][3] == (("d", 1, 2, "dicts", "unknown"),)
    assert got[7][3] == (("g", 1, 2, "others", None), ("g[1]", 0, 1, "numbers", None))


def test_segments_parts_and_repeated_documents(spark):
    """Of several segments of a type the first that has a part counts, with what it has; equal documents stay apart."""
    segments = [{"length": 1}, {"parallel_key": {"b": 1}, "designation": "x"}, {"parallel_key": {"b": 2, "c": 3}, "designation": ""}, {"stiffness": None}, {"stiffness": {"k": 1}}, {}]
    document = {"machine_id": "M1", "a": {"rotor": {"segments": segments}}, "x": [{"y": [1, 2]}, {"y": [3]}], "username": 1, "z": {"tag": {"q": 1}}}
    want = {"segments._total_count": 6, "segments._type_count": 1, "segments.unknown._count": 6, "segments.unknown.length": 1, "segments.unknown.parallel_key.b": 1, "segments.unknown.designation": "x"}
    want |= {"machine_id": "M1", "x[0].y._min": 1, "x[0].y._max": 2, "x[0].y._mean": 1.5, "x[0].y._count": 2, "x[1].y": 3}
    assert flat(spark, document) == [want]
    assert flat(spark, document, document | {"machine_id": "M2"})[1] == want | {"machine_id": "M2"}
    import json

    rows = spark.createDataFrame([("a", json.dumps(document))] * 2, "name string, text string")
    assert flatten.flatten_json(rows, F.col("text"), F.col("name")).count() == 2 * len(want)


def test_flatten(spark):
    got = flat(spark, DOCUMENT)[0]
    assert "none" not in got and "empty" not in got and "texts" not in got and not any(k.startswith("many") for k in got)
    assert got["one"] == 5 and got["flags._mean"] == 0.5 and got["flags._count"] == 2
    assert got["few[1].x"] == 2
    assert "load.voltage" not in got and got["load.torque"] == 8.5  # "voltage" holds "tag"
    assert got["RotorWorkflow.input.bearing_properties.bearing_1.d"] == 1  # in the order of the keys, not of the alphabet
    assert got["RotorWorkflow.input.bearing_properties.bearing_2.d"] == 2
    assert got["RotorWorkflow.input.bearing_properties.type"] == "ball"
    assert got["segments._total_count"] == 3 and got["segments._type_count"] == 2
    assert got["segments.shaft.length._sum"] == 4 and got["segments.fan.length"] == 4
    assert "segments.shaft.mass" not in got and got["segments.shaft.description"] == "d"
    assert got["segments.shaft.parallel_key.b"] == 2 and "segments.shaft.parallel_key.c" not in got
    assert got["segments.shaft._functions"] == "f; g" and got["segments.shaft.shoulder.left.r"] == 3
    assert got["shaft_safety.output.fatigue_strength._mean"] == 3 and got["shaft_safety.output.yield_strength._min"] == 3
    assert got["parallelkey_safety.output.position"] == 2 and got["parallelkey_safety.output.safety.key.s"] == 5
    assert got["roller_bearings.output.DE.name"] == "n" and got["roller_bearings.output.DE.f.r"] == 6


def test_json_folder(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"x": 1}')
    (tmp_path / "ignored.txt").write_text("{}")
    selection = tmp_path / "selection.csv"
    selection.write_text(
        "﻿Parameter,P_Name,Komponente,Einheit_,Fachkategorie,Datentyp\nload.torque,P_T,C_X,Nm,Dynamik,numerisch\none,P_T,C_X,Nm,Dynamik,numerisch\nload.torque,P_Q,–,–,?,kategorisch\nrotor.gone,–,,,,\n", encoding="utf-8"
    )
    features, bad = readers.read_json_features(spark, str(tmp_path), str(selection))
    got = {(r["component"], r["param"]): (r["value_num"], r["value_str"], r["unit"], r["ptype"]) for r in features.collect()}
    assert got == {("C_X", "P_T"): (5.0, None, "Nm", "DYN"), ("C_SONSTIGE", "P_Q"): (None, "8.5", "", "MISC")}
    assert {r["name"] for r in bad.collect()} == {"b", "c"}
    (tmp_path / "b.json").unlink()
    flat, n = readers.read_json_values(spark, str(tmp_path))
    assert n == 2 and {r["entity_id"] for r in flat.collect()} == {"M1", "c"}


SPECS = [("P_LEN", "C_WELLE", "GEOM", "numeric", "mm", ""), ("P_OK", "C_WELLE", "REQ", "boolean", "", ""), ("P_KIND", "C_LUEFTER", "MTRL", "enum", "", "{a, b}"), ("P_ODD", "C_X", "REQ", "other", "", "")]


def test_generate(spark, tmp_path):
    rows = generate.generate(spark, SPECS, 20, seed=1, missing_rate=0.3).orderBy("Design_ID", "Parameter_ID").collect()
    assert len(rows) == 80 and rows[0]["Design_ID"] == "D001"
    assert rows == generate.generate(spark, SPECS, 20, seed=1, missing_rate=0.3).repartition(7).orderBy("Design_ID", "Parameter_ID").collect()
    for r in rows:
        assert (r["Value"] == "") == bool(r["IsMissing"])
        if r["Value"] and r["Parameter_ID"] == "P_LEN":
            assert 10 <= float(r["Value"]) <= 500
    assert generate.numeric_range("mm", "P_STIRN") == (0.001, 0.2)
    assert generate.numeric_range("kg*mm2", "x") == (1_000.0, 5_000_000.0)
    assert generate.numeric_range("%", "x", 2.0) == (0.0, 150.0)
    generated = generate.generate(spark, SPECS, 3, seed=1)
    writers.write_generated(generated, str(tmp_path / "g"))
    assert readers.read_generated(spark, str(tmp_path / "g")).count() == 12


def test_graph_round_trip(spark, tmp_path):
    facts = generate.facts_of_generated(generate.generate(spark, SPECS, 5, seed=2, missing_rate=0.2))
    triples = graph.instances(facts)
    features = {(r["entity_id"], r["component"], r["param"]): (r["value_num"], r["value_str"]) for r in graph.features_of(triples).collect()}
    want = {}
    for r in facts.filter("Component_ID <> 'C_X'").collect():
        v = r["Value"]
        want["Rotor_" + r["Design_ID"], r["Component_ID"], r["Parameter_ID"]] = (float(v), None) if v and r["Parameter_ID"] == "P_LEN" else (None, v)
    assert features == want
    kept = graph.features_of(triples, nan_text_as_value=True).filter("value_str = 'nan'").count()
    assert kept == sum(v == (None, None) for v in want.values())
    writers.write_graph(triples, str(tmp_path / "g"))
    assert set(map(tuple, writers.read_graph(spark, str(tmp_path / "g")).collect())) == set(map(tuple, triples.collect()))


def test_survey(spark):
    rows = [("Welle (x)", "Beeinflusst", "Lüfter; y", "hoch", "0.5", "n"), ("Kunde", "Anfordert", "Welle", "mittel", "1", "n"), ("Aktivteil", "Anfordert", "Kosten", "mittel", None, None), ("Welle.", "Anfordert", "Welle", "mittel", "1", "n")]
    survey = spark.createDataFrame(rows, "Quelle string, Relation string, Ziel string, Staerke string, `Abhängigkeit_%` string, Notiz string")
    triples = graph.survey_edges(survey, 1)
    edges = {(r["source"], r["target"]): (r["strength"], r["percentage"]) for r in W.parse_edges(graph.edges_of(triples)).collect()}
    assert edges == {("Welle", "Lüfter"): ("hoch", 0.5), ("Aktivteil", "Kosten"): ("mittel", 0.5)}
    features = {r["s"].split("#")[1] for r in triples.filter(F.col("o").endswith("#Feature")).collect()}
    assert features == {"Kunde_1", "Kosten_1", "_1"}


def test_classes(spark):
    sheet = spark.createDataFrame([("Welle lang", "text"), ("Rotor", "nan")], "Label string, Description string")
    got = {(r["s"].split("#")[1], r["o"].split("#")[-1]) for r in graph.component_classes(sheet).collect()}
    assert got == {("Welle_lang", "Artefact"), ("Welle_lang", "Welle lang"), ("Welle_lang", "text"), ("Rotor", "Artefact"), ("Rotor", "Rotor")}
    facts = spark.createDataFrame([("d", "C_WELLE", "P X"), ("d", "C_NEUES_TEIL", "P_Y")], "Design_ID string, Component_ID string, Parameter_ID string")
    names = {r["s"].split("#")[1] for r in graph.classes_of_facts(facts).collect()}
    assert {"Welle", "Neues_teil", "Parameter", "P_X", "P_Y"} <= {n[0] + n[1:] for n in names} | {"Neues_teil"}


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "g.owl").write_text(
        '<rdf:RDF xmlns:rdf="r" xmlns:ex="e"><rdf:Description rdf:about="s1"><ex:part rdf:resource="o1"/><ex:part rdf:resource="o2"/><ex:name rdf:datatype="t">n</ex:name></rdf:Description>'
        '<rdf:Description rdf:about="s2"><ex:name>m</ex:name></rdf:Description></rdf:RDF>'
    )
    got = {(r["s"], r["p"], r["o"], r["o_is_iri"]) for r in readers.read_rdf_xml(spark, str(tmp_path / "g.owl"), {"ex": "http://e/"}).collect()}
    assert got == {("s1", "http://e/part", "o1", True), ("s1", "http://e/part", "o2", True), ("s1", "http://e/name", "n", False), ("s2", "http://e/name", "m", False)}


def test_bindings(spark):
    result = {"head": {"vars": ["x", "y"]}, "results": {"bindings": [{"x": {"value": "1"}}, {"x": {"value": "2"}, "y": {"value": "z"}}]}}
    assert [tuple(r) for r in readers.bindings(spark, result).collect()] == [("1", None), ("2", "z")]


def test_low_variance_and_catalogue(spark):
    from kindred.model import FEATURES

    f = spark.createDataFrame([(f"e{i}", "C", "flat", 100.0 + i * 0.1, None, None, "GEOM") for i in range(5)] + [(f"e{i}", "C", "wide", 10.0**i, None, None, "MTRL") for i in range(5)], FEATURES)
    assert [r["param"] for r in P.low_variance(f).collect()] == ["flat"]
    assert {r["label"]: r["params"] for r in P.catalogue(f).collect()} == {"Geometrie": ["flat"], "Material": ["wide"]}
