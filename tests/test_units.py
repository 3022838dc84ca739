import math

import pytest
from pyspark.sql import types as T

from lodeline.functions.units import note_unit, quantities, segment_unit
from lodeline.operators.units import in_common_units, in_other_units

C, S, E = "cutoff_energy", "smearing", "convergence_criteria.energy"


@pytest.mark.parametrize(
    "text,field,unit,ev",
    [
        ("50 Ry", C, "Ry", 680.28), ("0.43 keV", C, "keV", 430), ("about 30 Ha for the 3 heaviest species", C, "Ha", 816.34), ("E_cut = 1,200 electron volts", C, "eV", 1200),
        ("0,19 keV", C, "keV", 190), ("6.4 x 10^-17 J", C, "J", 399.46), ("截断能 40 里德伯", C, "Ry", 544.23), ("80 RY (plane wave)", C, "Ry", 1088.46),
        ("Methfessel-Paxton (order 1), 18 mHa", S, "mHa", 0.4898), ("Fermi-Dirac with width 50 1/cm", S, "cm-1", 0.0061992), ("Gaussian, 2,669 kelvin", S, "K", 0.22999),
        ("MP order 2; 4.2kJ mol⁻¹", S, "kJ/mol", 0.04353), ("12 毫电子伏特", S, "meV", 0.012), ("cold smearing, σ = 0,0056 Ry", S, "Ry", 0.07619), ("1.219 milli-Rydberg", S, "mRy", 0.016585),
        ("within 1e-5 Ry/atom over 3 cycles", E, "Ry", 1.36e-4), ("< 1d-4 kcal mol^-1 per cell", E, "kcal/mol", 4.3364e-6), ("10⁻⁶ E_h", E, "Ha", 2.7211e-5), ("1*10^{-7} eV", E, "eV", 1e-7), ("3.675e-7 a.u. per atom", E, "Ha", 1e-5),
    ],
)
def test_values(text, field, unit, ev):
    (q,) = quantities(text, field)
    assert q.unit == unit and math.isclose(q.ev, ev, rel_tol=2e-3)


def test_ranges_notes_and_absences():
    assert [(q.value, q.unit) for q in quantities("7.8 to 31.2 Ha", C)] == [(7.8, "Ha"), (31.2, "Ha")]
    assert [(q.value, q.unit) for q in quantities("370 eV (wavefunctions), 1480 eV (density)", C)] == [(370, "eV"), (1480, "eV")]
    assert quantities("50", C)[0].unit is None
    assert quantities("50", C, "All energies are quoted in Rydberg.")[0].unit == "Ry"
    assert quantities("50 eV", C, "能量单位：Ha")[0].unit == "eV"
    assert note_unit("k-mesh doubled") is None and note_unit(None) is None
    for text in (None, "", "default", "Methfessel-Paxton (order 1)", "x" * 10_000, "1" * 5000):
        assert all(q.unit is None for q in quantities(text, S))


def test_segments_prefer_the_longest_reading():
    assert segment_unit(" kJ mol-1/atom")[0].name == "kJ/mol"
    assert segment_unit(" milli-eV")[0].name == "meV"
    assert segment_unit(" species") == []


def test_long_texts_and_many_cuts():
    assert quantities("1 eV" + " per atom" * 300, C)[0].unit == "eV"
    assert len(quantities("5 " * 2000, C)) == 2000
    assert quantities("1 J" + " cm-1 K m mol-1" * 300, C)[0].unit is not None
    assert quantities("x" * 5000 + " 3 kilo-" + "joules per mole" + " y" * 3000, C)[0].unit == "kJ/mol"


def test_table(spark):
    setup = "struct<cutoff_energy:string,smearing:string,convergence_criteria:struct<energy:string,force:string>,note:string>"
    rows = [("p", "v1", ("50 Ry", None, ("1e-5 eV", None), None), 1), ("p", "v1", ("50 Ry", None, ("1e-5 eV", None), None), 1), ("q", None, None, 2), ("r", "v1", ("0 Ry", "", (None, None), "x"), 3)]
    df = spark.createDataFrame(rows, f"paper_id string, metadata_version string, computational_setup {setup}, field int")
    got = in_common_units(df)
    assert {(r.paper_id, r.field, r.unit, r.lg100) for r in got.collect()} == {("p", C, "Ry", 283), ("p", E, "eV", -500), ("r", C, "Ry", None)}
    assert [(r.paper_id, r.unit) for r in in_other_units(got).collect()] == [("p", "Ry")]
    assert in_common_units(df.limit(0)).count() == 0
    assert isinstance(got.schema["lg100"].dataType, T.LongType)
