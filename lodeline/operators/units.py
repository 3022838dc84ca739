"""Quantities of a table brought to common units.

Defined results: null, empty or wordy fields give no rows; a zero or negative value has no logarithm and is left
out of `lg100`; repeated rows give one row; a number without a unit anywhere has null unit and null ev.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import quantities

# The fields that hold energies, and the units other than eV that are reported.
FIELDS = {"cutoff_energy": "computational_setup.cutoff_energy", "smearing": "computational_setup.smearing", "convergence_criteria.energy": "computational_setup.convergence_criteria.energy"}
OTHER_UNITS = ("keV", "meV", "Ry", "mRy", "Ha", "mHa", "K", "cm-1", "J", "kJ/mol", "kcal/mol")


def in_common_units(df: DataFrame, keys: tuple[str, ...] = ("paper_id", "metadata_version"), fields: dict[str, str] = FIELDS, note: str = "computational_setup.note") -> DataFrame:
    """(keys, field, raw, value, unit, ev, lg100): every stated value of the fields, in eV."""
    cols = [F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    texts = F.array(*[F.struct(F.lit(name).alias("field"), F.col(path).alias("text")) for name, path in fields.items()])
    rows = df.select(*cols, F.col(note).alias("note"), F.inline(texts)).where("text is not null")
    # small strings, long parsing: the exchange of `distinct` must not shrink to one task
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw, value, unit, ev = [], [], [], [], []
            notes, names, strings = (b.column(c).to_pylist() for c in ("note", "field", "text"))
            for i, (n, f, t) in enumerate(zip(notes, names, strings)):
                for q in quantities(t, f, n):
                    at.append(i)
                    raw.append(q.raw)
                    value.append(q.value)
                    unit.append(q.unit)
                    ev.append(q.ev)
            lg = [None if e is None or not e > 0 or math.isinf(e) else round(100 * math.log10(e)) for e in ev]
            index = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(f"k{i}").take(index) for i in range(len(keys))], b.column("field").take(index), pa.array(raw, pa.string()), pa.array(value, pa.float64()), pa.array(unit, pa.string()), pa.array(ev, pa.float64()), pa.array(lg, pa.int64())], [*keys, "field", "raw", "value", "unit", "ev", "lg100"])

    schema = ", ".join([*[f"`{k}` string" for k in keys], "field string, raw string, value double, unit string, ev double, lg100 bigint"])
    return rows.mapInArrow(run, schema).distinct()


def in_other_units(values: DataFrame, units: tuple[str, ...] = OTHER_UNITS) -> DataFrame:
    """Values that were stated in one of the units and not in eV."""
    return values.where(F.col("unit").isin(*units) & F.col("lg100").isNotNull())
