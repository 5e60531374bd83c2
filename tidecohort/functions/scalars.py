"""Scalar functions of the domain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Canonical electrode names of the 10-20 system, and the regions of components in canonical order.
ELECTRODES = ["Fp1", "Fpz", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T3", "C3", "Cz", "C4", "T4", "T5", "P3", "Pz", "P4", "T6", "O1", "Oz", "O2", "A1", "A2"]
REGIONS = ["frontal_left", "frontal_right", "temporal_left", "temporal_right", "central_midline", "posterior_left", "posterior_right"]
# Prefixes of electrode names in order of trial, with the lobe of each.
LOBES = [
    ("FP", "frontal"), ("AF", "frontal"), ("FC", "central"), ("FT", "temporal"), ("TP", "temporal"), ("CP", "central"),
    ("PO", "posterior"), ("F", "frontal"), ("T", "temporal"), ("C", "central"), ("P", "posterior"), ("O", "posterior"),
]


def dipole_region(x: Column, y: Column, z: Column) -> Column:
    """Region of a dipole in head coordinates (metres)."""
    side = F.when(x < 0, "left").otherwise("right")
    return (
        F.when((z < 0.030) & (F.abs(x) > 0.035), F.concat(F.lit("temporal_"), side))
        .when(F.abs(x) < 0.015, "central_midline")
        .when(y > 0.030, F.concat(F.lit("frontal_"), side))
        .when(y < -0.020, F.concat(F.lit("posterior_"), side))
        .otherwise("central_midline")
    )


def electrode_region(name: Column) -> Column:
    """Region of an electrode name, marked or bare: odd numbers are left, even ones right, z is the midline."""
    upper = F.upper(bare_channel(name))
    digits = F.regexp_extract(upper, r"(\d+)$", 1)
    side = F.when(digits == "", None).when(digits.cast("int") % 2 == 1, "left").otherwise("right")
    lobe = F.lit("central")
    for prefix, place in reversed(LOBES):
        lobe = F.when(upper.startswith(prefix), place).otherwise(lobe)
    return F.when(side.isNull() | (lobe == "central"), "central_midline").otherwise(F.concat(lobe, F.lit("_"), side))


def bare_channel(name: Column) -> Column:
    """Channel name without reference and modality marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "(?i)-(REF|LE)$", ""), "(?i)^EEG ", ""))


def canonical_channel(name: Column) -> Column:
    """Channel name without reference and modality marks, in 10-20 spelling where it is one."""
    bare = bare_channel(name)
    known = F.create_map(*[F.lit(x) for e in ELECTRODES for x in (e.upper(), e)])
    return F.coalesce(F.element_at(known, F.upper(bare)), bare)


def header_age(header: Column) -> Column:
    """Age in an EDF patient field; -1 unless exactly one is given."""
    found = F.regexp_extract_all(header, F.lit(r"Age:(\d+)"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)).cast("int")).otherwise(-1)


def header_gender(header: Column) -> Column:
    """Gender in an EDF patient field; X unless exactly one is given."""
    found = F.regexp_extract_all(header, F.lit(r"\s([F|M])\s"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("X")


def strip_seed(overrides: Column) -> Column:
    """Overrides without the tokens that differ between runs of one configuration."""
    tokens = F.transform(F.split(overrides, ";"), lambda t: F.trim(t))
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.rlike(r"^(seed|data\.seed|output_dir|paths\.output_dir)=")), "; ")


def psd_variant(bipolar: Column, native: Column, interpolate: Column, aas: Column, notch: Column) -> Column:
    """Name of a spectrum's variant: its processing steps in fixed order, notch frequencies rounded."""
    flags = [F.when(c, n) for c, n in ((bipolar, "bipolar"), (native, "native"), (interpolate, "interp"), (aas, "aas"))]
    notched = F.when(F.size(notch) > 0, F.concat(F.lit("notch-"), F.array_join(F.transform(notch, lambda f: F.bround(f).cast("int").cast("string")), "-")))
    return F.concat_ws("-", F.lit("psd"), *flags, notched)


def path_part(path: Column, k: int) -> Column:
    """Part of a corpus path: 1 root folder, 2 subject, 3 session, 4 year, 5 montage, 6 file name."""
    return F.regexp_extract(path, r"([^/]+)/([^/]+)/(s\d+)_([^/]+)/([^/]+)/([^/]+)\.edf$", k)


def try_number(text: Column) -> Column:
    """A number, or 0 where the text is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def mean_with_deviation(mean: Column, deviation: Column, n: Column) -> Column:
    """``0.700 +/- 0.050``, or ``0.700 (n=1)`` where there is one run."""
    number = lambda c: F.format_string("%.3f", c)
    return F.when(mean.isNull(), F.lit("")).when((n <= 1) | deviation.isNull(), F.concat(number(mean), F.lit(" (n=1)"))).otherwise(F.concat(number(mean), F.lit(" +/- "), number(deviation)))


def markdown_row(*cells: Column) -> Column:
    """The cells of a row as a line of a Markdown table; null cells are empty."""
    return F.concat(F.lit("| "), F.array_join(F.array(*[c.cast("string") for c in cells]), " | ", ""), F.lit(" |"))


def stem_part(stem: Column, k: int) -> Column:
    """Part of a recording's stem: 1 subject, 2 session, 3 recording; empty where the name has another form."""
    return F.regexp_extract(stem, r"^([a-z0-9]+)_(s\d+)_(t\d+)", k)


def measured_on(year: Column) -> Column:
    """First day of the year of a session's folder; null where it is no year."""
    return F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))


def register(spark: SparkSession) -> None:
    """Expose the domain functions to SQL: temporary functions whose bodies are the expressions above."""
    bodies = {
        "tide_region": ("x DOUBLE, y DOUBLE, z DOUBLE", "CASE WHEN z < 0.030 AND abs(x) > 0.035 THEN concat('temporal_', side) WHEN abs(x) < 0.015 THEN 'central_midline' WHEN y > 0.030 THEN concat('frontal_', side) WHEN y < -0.020 THEN concat('posterior_', side) ELSE 'central_midline' END"),
    }
    side = "CASE WHEN x < 0 THEN 'left' ELSE 'right' END"
    for name, (arguments, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN {body.replace('side)', side + ')')}")
    bare = "trim(regexp_replace(regexp_replace(trim(name), '(?i)-(REF|LE)$', ''), '(?i)^EEG ', ''))"
    lobe = " ".join(f"WHEN startswith(upper({bare}), '{p}') THEN '{place}'" for p, place in LOBES)
    number = f"regexp_extract(upper({bare}), '([0-9]+)$', 1)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tide_electrode_region(name STRING) RETURNS STRING RETURN CASE WHEN {number} = '' OR (CASE {lobe} ELSE 'central' END) = 'central' THEN 'central_midline' ELSE concat(CASE {lobe} END, '_', CASE WHEN CAST({number} AS INT) % 2 = 1 THEN 'left' ELSE 'right' END) END")
    token = "'^(seed|data[.]seed|output_dir|paths[.]output_dir)='"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tide_strip_seed(overrides STRING) RETURNS STRING RETURN array_join(filter(transform(split(overrides, ';'), t -> trim(t)), t -> t <> '' AND NOT t RLIKE {token}), '; ')")
