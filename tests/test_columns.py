import math

import pytest
from pyspark.sql import functions as F

from kindred.functions import columns as C
from kindred.model import CATEGORIES, GEOMETRY, REQUIREMENT, category


def each(spark, f, values, kind="string"):
    rows = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)]
    names = [f"x{j}" for j in range(len(rows[0]) - 1)]
    kinds = kind.split(",") if "," in kind else [kind] * len(names)
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return [r[0] for r in df.orderBy("i").select(f(*map(F.col, names))).collect()]


def test_local_name(spark):
    assert each(spark, C.local_name, ["http://x/y#A_1", "http://x/y#a#b", "http://x/y/z", "plain", None]) == ["A_1", "a#b", "z", "plain", None]


def test_strip_suffix(spark):
    assert each(spark, C.strip_suffix, ["C_WELLE_D001", "WELLE", "a_", None]) == ["C_WELLE", "WELLE", "a", None]


@pytest.mark.parametrize(
    ("name", "base"),
    [
        ("P_WELLE_TIR_D001", "P_WELLE_TIR"),
        ("P_WELLE_TIR_2025-11-30_1", "P_WELLE_TIR"),
        ("P_AKTIV_LAENGE_XYZ", "P_AKTIV_LAENGE"),
        ("P_LUEFTER_D", "P_LUEFTER"),
        ("P_WELLE_TIR", "P_WELLE"),
        ("P_MASSE_1QA1452-8JA60-0HG2-Z", "P_MASSE"),
        ("P_WELLE_LAENGE", "P_WELLE_LAENGE"),
        ("P_X_12", "P_X"),
        ("PLAIN", "PLAIN"),
    ],
)
def test_base_param(spark, name, base):
    assert each(spark, C.base_param, [name]) == [base]


def test_safe_float(spark):
    texts = ["12.5", "12,5", '"12.5"', "", "NaN", None, "ABC", "1.0d", "1.234,5", " 7\t", "-inf", "1e3", "."]
    assert each(spark, C.safe_float, texts) == [12.5, 12.5, 12.5, None, None, None, None, None, None, 7.0, -math.inf, 1000.0, None]


def test_scale_has_no_division_by_zero(spark):
    got = each(spark, C.scale, [(5.0, 0.0, 10.0), (20.0, 0.0, 10.0), (3.0, 3.0, 3.0), (3.0, None, None)], "double")
    assert got == [0.5, 1.0, 0.5, 0.5]


def test_exact_round():
    assert C.exact_round(2.675, 2) == 2.67
    assert C.exact_round(0.125, 2) == 0.12
    assert C.exact_round(None, 2) is None


def test_detect_component(spark):
    got = each(spark, C.detect_component, [("Die Welle hat...", 5), ("Wellenende", 1), ("ein LÜFTER", 2), ("unbekannt", 1), (None, 1)], "string,int")
    assert got == ["C_WELLE_5", "C_WELLE_1", "C_LUEFTER_2", None, None]


def test_edge_parts(spark):
    got = each(spark, C.edge_parts, ["Blech.paket_Beeinflusst_Welle_1", "A_affectsStrength_B_C_1", "A_Anfordert_B", "A_kennt_B", "A_Beeinflusst_B_Beeinflusst_C"])
    assert [tuple(x) if x else x for x in got] == [("Blech_paket", "Welle"), ("A", "B_C"), ("A", "B"), None, None]


def test_edge_percentage(spark):
    assert each(spark, C.edge_percentage, ["0,8", "0", "x", None]) == [0.8, 0.5, 0.5, 0.5]


def test_param_id_from_path(spark):
    got = each(spark, C.param_id_from_path, ["RotorWorkflow.output.output.roller_bearings.output.NDE.forces.radial", "output.input", "a.b.c.d.e.f.g"])
    assert got == ["P_ROLLER_BEARINGS_NDE_FORCES_RADIAL", "P_OUTPUT_INPUT", "P_C_D_E_F_G"]


def test_area(spark):
    paths = ["SimocalcWorkflow.input.x", "SimocalcWorkflow.x", "segments.a", "x.load.y", "machine_id", "other", "RotorWorkflow.input.q"]
    assert each(spark, C.area, paths) == ["Simocalc (Input)", "Simocalc (Output)", "Segmente", "Lastdaten", "Meta", "Sonstige", "Rotor (Input)"]


def test_enum_values(spark):
    assert each(spark, C.enum_values, ["{a, b}", "", "{ }", "x"]) == [["a", "b"], [], [], ["x"]]
    assert [C.parse_enum(t) for t in ("{a, b}", "", "{ }", "x")] == [["a", "b"], [], [], ["x"]]


def test_labels(spark):
    assert each(spark, C.coverage_step, [100.0, 99.0, 30.0, 1.0], "double") == ["100 % (vollstaendig)", "70-99 %", "30-69 %", "< 30 %"]
    assert each(spark, C.stars, [0.0001, 0.005, 0.04, 0.2], "double") == ["***", "**", "*", "n.s."]
    assert each(spark, C.agreement, [0.7, 0.4, -0.9], "double") == ["stark", "moderat", "schwach"]
    assert each(spark, C.correlation_strength, [-0.95, 0.7, 0.1], "double") == ["sehr stark", "stark", "vernachlässigbar"]
    assert each(spark, C.heading_ptype, ["Geometrie", "?", None]) == ["GEOM", "MISC", "MISC"]


def test_category(spark):
    assert each(spark, category, [" DYN ", None, "?", "ELEC"]) == [GEOMETRY, REQUIREMENT, REQUIREMENT, REQUIREMENT]
    assert len(CATEGORIES) == 3
