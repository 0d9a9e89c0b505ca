"""Sources and sinks: catalogue, field loaders, text formats, declarative datasets."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeaxis as ta
from ..functions.scalar import DAYS_PER_YEAR, SECONDS_PER_DAY, si_unit, to_si
from ..operators import regress, resample, vertical

SECONDS_A_YEAR = DAYS_PER_YEAR * SECONDS_PER_DAY

# Field -> (variable, table) of the common catalogue.
VARIABLES: dict[str, tuple[str, str]] = {
    "clwvi": ("clwvi", "Amon"),
    "rsdt": ("rsdt", "Amon"),
    "rsut": ("rsut", "Amon"),
    "rlut": ("rlut", "Amon"),
    "cldlow": ("cl", "Amon"),
    "cldhigh": ("cl", "Amon"),
    "tas": ("tas", "Amon"),
    "tos": ("tos", "Omon"),
    "siconc": ("siconc", "SImon"),
    "ohc300": ("thetao", "Omon"),
    "ohc700": ("thetao", "Omon"),
}
# Field -> (model variable, component).
MODEL_VARIABLES: dict[str, tuple[str, str]] = {
    "rsdt": ("SOLIN", "atm"),
    "rsut": ("FSUTOA", "atm"),
    "rlut": ("FLUT", "atm"),
    "cldlow": ("CLOUD", "atm"),
    "cldhigh": ("CLOUD", "atm"),
    "tas": ("TREFHT", "atm"),
    "tos": ("SST", "ocn"),
    "siconc": ("aice", "ice"),
    "ohc300": ("TEMP", "ocn"),
    "ohc700": ("TEMP", "ocn"),
}
# Model output names -> common field names, and back.
CESM_TO_CF = {"TREFHT": "tas", "SST": "tos", "RESTOM": "eei", "RESTOA": "eei", "FSUTOA": "rsut", "FSUT": "rsut", "FLUTOA": "rlut", "FSNTOA": "rsnt", "FLUT": "rlut", "SOLIN": "rsdt", "CLDLOW": "cll", "CLDMED": "clm", "CLDHGH": "clh", "ICEFRAC": "siconc"}
CF_TO_CESM = {"tas": "TREFHT", "tos": "SST", "eei": "RESTOM", "rsut": "FSUTOA", "rlut": "FLUTOA", "rsnt": "FSNTOA", "rsdt": "SOLIN", "cll": "CLDLOW", "clm": "CLDMED", "clh": "CLDHGH", "siconc": "ICEFRAC"}
# What a field's numbers are divided by for display.
SCALING = {"ohc300": 1e6, "ohc300_total": 1e21, "ohc_total": 1e21, "siconc": 1e-2, "siconcn": 1e-2, "siconcs": 1e-2, "clt": 1e-2, "cll": 1e-2, "clm": 1e-2, "clh": 1e-2, "siarean": 1e6, "siareas": 1e6, "siextentn": 1e6, "siextents": 1e6}
RENAMES = {"latitude": "lat", "longitude": "lon", "nlat": "lat", "nlon": "lon", "TLAT": "lat", "TLONG": "lon", "ULAT": "lat", "ULONG": "lon", "plev": "lev"}
_ONE = ("member_id", "grid_label", "version", "time_range")


def standard_names(df: DataFrame) -> DataFrame:
    """Coordinate columns under their common names."""
    return df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in df.columns and b not in df.columns})


def map_names(names: str | list, table: dict[str, str]):
    """Names through a table, unknown ones as they are; lists element by element."""
    return [map_names(n, table) for n in names] if isinstance(names, list) else table.get(names, names)


def variables(names: list[str]) -> list[tuple[str, str]]:
    if unknown := [n for n in names if n not in VARIABLES]:
        raise ValueError(f"unknown variables {unknown}")
    return [VARIABLES[n] for n in names]


def build_catalog(spark: SparkSession, root: str) -> DataFrame:
    """A row for each file under ``source/experiment/member/table/variable/grid/version/file``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    parts = F.split("path", "/")
    names = ("source_id", "experiment_id", "member_id", "table_id", "variable_id", "grid_label", "version", "file")
    out = files.select("path", *[F.element_at(parts, -8 + k).alias(n) for k, n in enumerate(names)])
    return out.withColumn("time_range", F.regexp_extract("file", r"(\d{4,6}-\d{4,6})", 1)).drop("file")


def search_catalog(catalog: DataFrame, source: str, experiment: str, fields: list[str], **where: str) -> DataFrame:
    """Rows of the asked variables that exist; each must be one dataset."""
    want = catalog.sparkSession.createDataFrame(variables(fields), "variable_id string, table_id string")
    found = catalog.where((F.col("source_id") == source) & (F.col("experiment_id") == experiment)).join(F.broadcast(want), ["variable_id", "table_id"], "left_semi")  # a few names
    for k, v in where.items():
        found = found.where(F.col(k) == v)
    several = found.groupBy("variable_id", "table_id").agg(*[F.countDistinct(c).alias(c) for c in _ONE if c != "time_range"])
    bad = several.where(" or ".join(f"{c} > 1" for c in _ONE if c != "time_range")).count()
    if bad:
        raise ValueError("the search leaves several datasets for a variable; name member, grid or version")
    return found


def load_fields(catalog: DataFrame, source: str, experiment: str, fields: list[str], years: tuple[int, int] | None = None, prepare: Callable[[DataFrame, str], DataFrame] | None = None, **where: str) -> DataFrame:
    """Long monthly fields in SI units: ``field, year, month, lat, lon[, lev], value``."""
    spark, out = catalog.sparkSession, None
    found = search_catalog(catalog, source, experiment, fields, **where)
    paths: dict[str, list[str]] = {}
    for r in found.select("variable_id", "path").collect():  # names of files
        paths.setdefault(r["variable_id"], []).append(r["path"])
    for f in fields:
        if own := paths.get(VARIABLES[f][0]):
            df = standard_names(spark.read.parquet(*own))
            df = df.withColumns({"value": F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")), "field": F.lit(f)})
            if "units" in df.columns:
                df = df.withColumn("value", to_si(F.col("value"), F.col("units"))).withColumn("units", si_unit(F.col("units")))
            if years:
                df = df.where(F.col("year").between(*years))
            df = prepare(df, f) if prepare else postprocessed(df, f)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("none of the variables is in the catalogue")
    return out


def derived_fields(df: DataFrame, keys: list[str]) -> DataFrame:
    """Radiation and precipitation sums of model output, as further rows; a missing part makes the sum missing."""
    parts = ["SOLIN", "FSNT", "FSNTC", "FLNT", "FLNTC", "FLUT", "FSUTOA", "PRECC", "PRECL"]
    wide = df.groupBy(*keys).pivot("field", parts).agg(F.first("value"))
    c = F.col
    out = {
        "FLDT": c("FLNT") - c("FLUT"),
        "FSUT": c("SOLIN") - c("FSNT"),
        "RESTOM": c("FSNT") - c("FLNT"),
        "RESTOA": c("SOLIN") - c("FSUTOA") - c("FLUT"),
        "RESTOMC": c("FSNTC") - c("FLNTC"),
        "CRE": (c("FSNT") - c("FLNT")) - (c("FSNTC") - c("FLNTC")),
        "PREC": c("PRECC") + c("PRECL"),
    }
    rows = wide.select(*keys, F.explode(F.create_map(*[x for k, e in out.items() for x in (F.lit(k), e)])).alias("field", "value"))
    return df.select(*keys, "field", "value").unionByName(rows.where("value is not null").select(*keys, "field", "value"))


def scaled(df: DataFrame, value: str = "value") -> DataFrame:
    """Values over their field's display scale."""
    table = F.create_map(*[F.lit(x) for k, s in SCALING.items() for x in (k, s)])
    return df.withColumn(value, F.col(value) / F.coalesce(table[F.col("field")], F.lit(1.0)))


def postprocessed(df: DataFrame, field_name: str) -> DataFrame:
    """Fields that are drawn from a column: low and high clouds, heat content of the upper ocean."""
    by = [c for c in ("field", "year", "month", "lat", "lon") if c in df.columns]
    if field_name in ("cldlow", "cldhigh"):
        return vertical.cloud_fraction(df, by, "maxrandom", field_name.removeprefix("cld"))
    if field_name in ("ohc300", "ohc700"):
        levels = df if "dz" in df.columns else vertical.level_thickness(df, by)
        return vertical.ohc(levels, by, float(field_name.removeprefix("ohc")))
    return df


def load_model_fields(spark: SparkSession, path: str, fields: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Long monthly fields of model output under ``path/component/variable``.

    Months are preferred; where only days exist they are averaged.  The fields
    must share their coordinates: a key that one has and another lacks is an error.
    """
    out = None
    for f in fields:
        if f not in MODEL_VARIABLES:
            raise ValueError(f"unknown variable {f}")
        var, component = MODEL_VARIABLES[f]
        try:
            df = standard_names(spark.read.parquet(f"{path}/{component}/month/{var}"))
        except AnalysisException:
            daily = standard_names(spark.read.parquet(f"{path}/{component}/day/{var}"))
            keys = [c for c in ("lat", "lon", "lev", "dz", "units") if c in daily.columns]
            df = daily.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("value").alias("value"))
        if years:
            df = df.where(F.col("year").between(*years))
        df = df.withColumns({"value": F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")), "field": F.lit(f)})
        if "units" in df.columns:
            df = df.withColumn("value", to_si(F.col("value"), F.col("units")))
        if "lev" in df.columns and component == "atm":
            df = df.withColumn("lev", F.col("lev") * 100)  # hPa
        df = postprocessed(df, f).select("field", "year", "month", "lat", "lon", "value")
        out = df if out is None else out.unionByName(df)
    n = out.groupBy("year", "month", "lat", "lon").agg(F.countDistinct("field").alias("_n"))
    checked = n.withColumn("_e", F.when(F.col("_n") < len(fields), F.raise_error(F.lit("coordinates differ")))).where(F.col("_e").isNull()).select("year", "month", "lat", "lon")
    return out.join(checked, ["year", "month", "lat", "lon"], "left_semi").select("field", "year", "month", "lat", "lon", "value")


def fixed_stamp(time: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Middle of the bounds; without bounds, the middle of the month before the stamp."""
    if start is not None and end is not None:
        return F.timestamp_seconds((F.unix_timestamp(start) + F.unix_timestamp(end)) / 2)
    before = F.add_months(time, -1)
    first = F.trunc(before, "month")
    return F.timestamp_seconds(F.unix_timestamp(first.cast("timestamp")) + F.dayofmonth(F.last_day(first)) * 43_200)


def files_of_years(files: DataFrame, year_start: int, year_end: int) -> DataFrame:
    """Rows of a file listing whose name carries a year of the range."""
    y = F.regexp_extract("path", r"\.(\d{4})(?:-\d{2})?[^/]*$", 1)
    return files.where((y != "") & y.cast("int").between(year_start, year_end))


def merge_exact(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Outer merge that fails at run time where a key stands on one side only."""
    la, rb = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    m = la.join(rb, keys, "full_outer")
    return m.withColumn("_e", F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("coordinates differ")))).where(F.col("_e").isNull()).drop("_a", "_b", "_e")


# -- text formats -----------------------------------------------------------


def parse_noaa(text: str) -> tuple[dict[str, str], list[str], list[list[str]]]:
    """Metadata, column names and rows of a paleoclimate text file.

    ``# key: value`` lines are metadata, ``## name<tab>...`` lines name the
    columns, other lines are the table with the header first.  Latitude and
    longitude are the middle of their bounds.
    """
    meta: dict[str, str] = {}
    columns: list[str] = []
    rows: list[list[str]] = []
    for line in text.splitlines():
        if line.startswith("##"):
            if name := line[2:].split("\t")[0].strip():
                columns.append(name)
        elif line.startswith("#"):
            k, sep, v = line[1:].partition(":")
            if sep and v.strip():
                meta.setdefault(k.strip().lower().replace(" ", "_").replace("-", "_"), v.strip())
        elif line.strip():
            rows.append(line.split("\t") if "\t" in line else line.split())
    for axis, lo, hi in (("lat", "southernmost_latitude", "northernmost_latitude"), ("lon", "westernmost_longitude", "easternmost_longitude")):
        if lo in meta and hi in meta:
            meta[axis] = str((float(meta[lo]) + float(meta[hi])) / 2)
    return meta, columns, rows[1:]


def load_noaa(spark: SparkSession, path: str, value: str, time: str = "age_CE") -> DataFrame:
    """``file, t, value, lat, lon`` of text files, a file parsed in one task."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                meta, names, rows = parse_noaa(bytes(raw).decode("utf-8", "replace"))
                if time in names and value in names:
                    i, j = names.index(time), names.index(value)
                    num = lambda s: float(s) if re.fullmatch(r"[-+]?[\d.]+(?:[eE][-+]?\d+)?", s.strip()) else None
                    data = [(p, num(r[i]), num(r[j]), float(meta.get("lat", "nan")), float(meta.get("lon", "nan"))) for r in rows if len(r) > max(i, j)]
                    yield pd.DataFrame(data, columns=["file", "t", "value", "lat", "lon"]).dropna(subset=["t", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, t double, value double, lat double, lon double")


def select_pages2k(df: DataFrame) -> DataFrame:
    return df.where(F.col("pages2kID").isNotNull() & ~F.col("pages2kID").startswith("X"))


def select_ch2k(df: DataFrame) -> DataFrame:
    """Coral d18O and Sr/Ca series that are neither seawater nor annual copies; each id once."""
    out = df.where(F.col("variable").isin("d18O", "Sr/Ca") & ~F.col("TSid").contains("_sw") & ~F.col("TSid").contains("_annual"))
    n = F.count(F.lit(1)).over(Window.partitionBy("TSid"))
    return out.withColumn("_e", F.when(n > 1, F.raise_error(F.lit("an id stands twice")))).where(F.col("_e").isNull()).drop("_e")


def load_monthly_csv(spark: SparkSession, paths: list[str], value: str, missing: float = -9999.0) -> DataFrame:
    """Yearly values of twelve files, one a month, as ``year, month, value``."""
    out = None
    for path in paths:
        df = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
        df = df.withColumnsRenamed({c: c.strip() for c in df.columns})
        mo = next(c for c in df.columns if c.lower() in ("mo", "month"))
        df = df.select(F.col("year").cast("int").alias("year"), F.col(mo).cast("int").alias("month"), F.nullif(F.col(value).cast("double"), F.lit(missing)).alias("value"))
        out = df if out is None else out.unionByName(df)
    return out.orderBy("year", "month")


def load_fixed_text(spark: SparkSession, path: str, names: list[str], skip: int = 0, sep: str = r"\s+", comment: str = "#") -> DataFrame:
    """Numbers of a blank- or tab-separated text after ``skip`` lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("k", "line"))
    fields = F.split(F.trim("line"), sep)
    rows = lines.where((F.col("k") >= skip) & (F.trim("line") != "") & ~F.trim("line").startswith(comment))
    return rows.select(*[F.try_element_at(fields, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])


# -- declarative datasets ---------------------------------------------------


@dataclass(frozen=True)
class DatasetSpec:
    """How a product becomes a field table.

    ``path`` lies below a root; braces in it are filled from ``versions`` or by the caller.  A CSV holds one row a step.
    ``members`` are (label, path) of parts that are put together along ``member``.  Fields are the columns named; without
    names all columns but the coordinates.  ``rates``: time derivative of a field, a second.  Fields in ``anomalies`` (all,
    if none are named) become anomalies of ``anomaly_period``, which holds its first year and not its last.
    """

    path: str
    renames: dict[str, str] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    derived: dict[str, str] = field(default_factory=dict)
    fields: tuple[str, ...] = ()
    year_offset: int = 0
    wrap_lon: bool = False
    seasonal: bool = False
    anomaly_period: tuple[int, int] | None = None
    anomalies: tuple[str, ...] = ()
    stack: tuple[str, ...] = ()
    keep_years: tuple[int, int] | None = None
    drop: tuple[str, ...] = ()
    rates: dict[str, str] = field(default_factory=dict)
    sea_ice: tuple[str, ...] = ()
    melt: tuple[str, str] | None = None
    member: str | None = None
    members: tuple[tuple[str, str], ...] = ()
    versions: dict[str, str] = field(default_factory=dict)
    separator: str = ","


# Names and units of the products, and the years that they are related to.
_BASE = (1961, 1991)
_OUTGOING = "-(rsut + rlut)"
_LMR = "production_ccsm4_pagesv2_wCoral_gis_seaslinobj_online_20m20sOHC_past1000"
_LMR_FIELDS = ("tas", "tos", "rsut", "rlut", "ohc700", "eei", "ddtohc700")
_LMR_NAMES = {"tas_sfc": "tas", "tos_sfc": "tos", "rlut_toa": "rlut", "rsut_toa": "rsut", "ohc_0-700m": "ohc700"}
_ERBE = DatasetSpec("", {"TOA_SW_FLUX": "rsut", "TOA_LW_FLUX": "rlut", "TOA_INCOMING_SOLAR": "rsdt", "TOA_NET_FLUX": "eei"}, fields=("rsut", "rlut", "rsdt", "eei"), anomaly_period=(1985, 1999))
_CERES = ("eei", "rsut", "rlut", "rsdt", "clt")
_ICE = ("siarean", "siareas", "siextentn", "siextents")

#: Products by name. Two more are tables of events: ``load_evolv2k`` and ``load_combined_eruptions``.
DATASETS: dict[str, DatasetSpec] = {
    "lmronline": DatasetSpec("lmronline/{version}/spatial_ens_mean", _LMR_NAMES, derived={"eei": _OUTGOING}, fields=_LMR_FIELDS, rates={"ohc700": "ddtohc700"}, anomaly_period=_BASE, versions={"version": _LMR}),
    "lmronline_global_mean": DatasetSpec("lmronline/{version}/indices", _LMR_NAMES, derived={"eei": _OUTGOING}, fields=_LMR_FIELDS, rates={"ohc700": "ddtohc700"}, anomaly_period=_BASE, stack=("mc_iteration", "ensemble_member"), versions={"version": _LMR}),
    "anna": DatasetSpec("anna.parquet", derived={"eei": _OUTGOING}, fields=("rlut", "rsut", "eei"), anomaly_period=_BASE),
    "era5": DatasetSpec("era5.parquet", fields=("tas",), anomaly_period=_BASE),
    "gistemp": DatasetSpec("gistemp.parquet", fields=("tas",), anomaly_period=_BASE),
    "ersst": DatasetSpec("ersst.parquet", fields=("tos",), anomaly_period=_BASE),
    "cobesst": DatasetSpec("cobesst.parquet", fields=("tos",), anomaly_period=_BASE),
    "hadisst": DatasetSpec("hadisst.parquet", fields=("tos",), anomaly_period=_BASE),
    "hadcrut": DatasetSpec("hadcrut.parquet", {"tas_mean": "tas"}, fields=("tas",), wrap_lon=True, seasonal=True, anomaly_period=_BASE, drop=("realization",)),
    "zanna": DatasetSpec("zanna.parquet", {"time (starting 1870)": "year", "OHC_300m": "ohc300", "OHC_700m": "ohc700", "OHC_2000m": "ohc2000", "OHC_full_depth": "ohc"}, {f: 1e21 for f in ("ohc300", "ohc700", "ohc2000", "ohc")}, fields=("ohc300", "ohc700", "ohc2000", "ohc"), year_offset=1870, anomaly_period=(1961, 1990)),
    "wu2025": DatasetSpec("wu2025.parquet", fields=("ohc300", "ohc2000", "ddtohc2000", "eei", "eei_stde"), anomaly_period=(1961, 1990), anomalies=("ohc300", "ohc2000")),
    "gebbie2019": DatasetSpec("gebbie2019.parquet", fields=("tos", "ohc300", "ohc700", "ohc")),
    "cheng2017": DatasetSpec("cheng2017.parquet", fields=("ohc300", "ohc2000"), anomaly_period=_BASE),
    "iapv4": DatasetSpec("iapv4.parquet", fields=("ohc300", "ohc2000", "ohc6000"), anomaly_period=_BASE),
    "smith2025_eei": DatasetSpec("earth_energy_imbalance.csv", {"time": "year", "ocean_0-700m": "ohc700", "ocean_full-depth": "ohc", "total": "ehc"}, {f: 1e21 for f in ("ohc700", "ohc2000", "ohc", "ehc")}, {"ohc2000": "ohc700 + `ocean_700-2000m`"}, ("ohc700", "ohc2000", "ohc", "ehc")),
    "modera": DatasetSpec("modera.parquet", {"temp2": "tas"}, fields=("tas",), seasonal=True, anomaly_period=_BASE),
    "moderac": DatasetSpec("moderac.parquet", {"temp2": "tas"}, fields=("tas",), seasonal=True, anomaly_period=_BASE),
    "pages19": DatasetSpec("pages19.parquet", fields=("tas",), keep_years=(850, 2000), drop=("LMRv2.1",), melt=("method", "tas"), stack=("ens", "method"), anomaly_period=_BASE),
    "brennan22": DatasetSpec("brennan22_{prior}.parquet", {"sic_lalo_ensemble_mean": "siconc", "si_extent_anomalies": "siextentn", "si_area_anomalies": "siarean"}, {"siconc": 0.01, "siarean": 1e6, "siextentn": 1e6}, fields=("siconc", "siextentn", "siarean"), anomaly_period=_BASE, anomalies=("siarean", "siextentn"), stack=("nens", "nit"), versions={"prior": "CCSM4"}),
    "cooper25": DatasetSpec("cooper25.parquet", fields=("tas", "tos", "siconc"), anomaly_period=_BASE, anomalies=("tas", "tos"), sea_ice=_ICE),
    "siindex": DatasetSpec("siindex/{hemisphere}/{month:02}.csv", fields=("siextentn", "siarean", "siextents", "siareas"), seasonal=True, anomaly_period=(1979, 2001)),
    "cdr_sic": DatasetSpec("cdr_sic.parquet", fields=("siconc",), sea_ice=_ICE),
    "walsh19": DatasetSpec("walsh19.parquet", fields=("siconc",), sea_ice=("siarean", "siextentn")),
    "erbe_wfov": replace(_ERBE, path="erbe_wfov.parquet"),
    "erbe_wfov_global_mean": replace(_ERBE, path="erbe_wfov_global_mean.parquet"),
    "deepc": DatasetSpec("deepc.parquet", fields=("eei", "rsut", "rlut"), seasonal=True, anomaly_period=(1985, 1999)),
    "ceres": DatasetSpec("ceres.parquet", {"toa_sw_all_mon": "rsut", "toa_lw_all_mon": "rlut", "toa_net_all_mon": "eei", "solar_mon": "rsdt", "cldarea_total_daynight_mon": "clt"}, fields=_CERES),
    "ceresgm": DatasetSpec("ceresgm.parquet", {"gtoa_sw_all_mon": "rsut", "gtoa_lw_all_mon": "rlut", "gtoa_net_all_mon": "eei", "gsolar_mon": "rsdt", "gcldarea_total_daynight_mon": "clt"}, fields=_CERES),
    "haden4": DatasetSpec("haden4.parquet", fields=("ohc300", "ohc700"), anomaly_period=_BASE),
    "ps2004": DatasetSpec("ps2004.parquet", fields=("tas",), anomaly_period=_BASE),
    "satire_solar": DatasetSpec("satire_solar.parquet", fields=("tsi",)),
    "meng25": DatasetSpec("meng25_{prior}.parquet", {"Nino34": "nino34", "SIE": "siextentn"}, {"siextentn": 1e-6}, keep_years=(850, 9999), drop=("Nino1+2", "Nino3", "Nino4", "IOD", "IOBW", "GMOHC", "GMT", "NH-Temp", "SH-Temp"), anomaly_period=_BASE, versions={"prior": "CCSM4"}),
    "ar6_erf": DatasetSpec("", member="stat", members=(("mean", "AR6_ERF_1750-2019.csv"), ("p05", "AR6_ERF_1750-2019_pc05.csv"), ("p95", "AR6_ERF_1750-2019_pc95.csv"))),
    "andrews2022_feedbacks": DatasetSpec("", {"dt": "tas", "dn": "eei"}, fields=("tas", "eei"), member="model", members=tuple((m, f"amip-piForcing_{m}.parquet") for m in ("CESM2", "CanESM5", "CNRM-CM6-1", "HadGEM3-GC31-LL", "IPSL-CM6A-LR", "MIROC6", "MRI-ESM2-0"))),
    "cmip6_amip_bcs": DatasetSpec("amip_seasonal.parquet", fields=("tos", "siconc"), anomaly_period=_BASE),
    "dalaiden2023": DatasetSpec("dalaiden2023.parquet", {"SIC": "siconc"}, {"siconc": 0.01}, fields=("siconc",), sea_ice=_ICE),
}

COORDS = ("ens", "stat", "model", "year", "season", "month", "lat", "lon", "lev")


def _table(spark: SparkSession, path: str, spec: DatasetSpec) -> DataFrame:
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    df = spark.read.option("header", "true").option("sep", spec.separator).csv(path)
    return df.select(*[F.col(f"`{c}`").try_cast("double").alias(c.strip()) for c in df.columns])


def _monthly_index(spark: SparkSession, root: str, spec: DatasetSpec) -> DataFrame:
    """``field, year, month, value``: extent and area of both hemispheres from files by calendar month."""
    out = None
    for hemisphere in ("north", "south"):
        paths = [f"{root}/{spec.path.format(hemisphere=hemisphere, month=m)}" for m in range(1, 13)]
        for column in ("extent", "area"):
            part = load_monthly_csv(spark, paths, column).select(F.lit(f"si{column}{hemisphere[0]}").alias("field"), "year", "month", "value")
            out = part if out is None else out.unionByName(part)
    return out


def _ice_totals(long: DataFrame, names: tuple[str, ...], over: list[str]) -> DataFrame:
    """Rows of sea-ice area and extent (km2) of the field ``siconc``; the grid's steps are those of its coordinates."""
    ice = long.where("field = 'siconc'")
    steps = []
    for axis in ("lat", "lon"):
        # Distinct coordinates are as many as the grid has rows or columns.
        first, second = ([*(r[0] for r in ice.select(axis).distinct().orderBy(axis).limit(2).collect()), None, None])[:2]
        if second is None:
            raise ValueError(f"sea-ice totals need a grid of more than one {axis}")
        steps.append(second - first)
    total = vertical.sea_ice(ice, over, *steps).withColumnsRenamed({f"{a}_{h}": f"si{a}{h}" for a in ("area", "extent") for h in "ns"})
    return total.unpivot(over, list(names), "field", "value")


def load_dataset(spark: SparkSession, root: str, name: str, spec: DatasetSpec | None = None, anomalies: bool = True, **versions: str) -> DataFrame:
    """Long table of a product: ``field``, its coordinates and ``value``.

    ``anomalies`` false leaves absolute values; ``versions`` fill the names in a path (``prior="MPI"``).  Totals (sea ice) have
    null coordinates where the fields have a place.  NaN is null.
    """
    spec = spec or DATASETS[name]
    if name == "siindex":
        long, coords = _monthly_index(spark, root, spec), ["year", "month"]
    else:
        path = spec.path.format(**{**spec.versions, **versions})
        parts = [_table(spark, f"{root}/{p}", spec).withColumn(spec.member, F.lit(label)) for label, p in spec.members] or [_table(spark, f"{root}/{path}", spec)]
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part, allowMissingColumns=True)
        df = standard_names(df.withColumnsRenamed(spec.renames)).drop(*[c for c in spec.drop if c in df.columns])
        for c, e in spec.derived.items():
            if c not in df.columns:
                df = df.withColumn(c, F.expr(e))
        for c, k in spec.scale.items():
            if c in df.columns:
                df = df.withColumn(c, F.col(c) * k)
        if "year" in df.columns and df.schema["year"].dataType.simpleString() in ("double", "float"):
            df = df.withColumn("year", F.floor("year").cast("int"))
        if spec.year_offset:
            df = df.withColumn("year", F.col("year") + spec.year_offset)
        if spec.wrap_lon:
            df = df.withColumn("lon", F.pmod("lon", F.lit(360.0)))
        if spec.melt:
            label, value = spec.melt
            keep = [c for c in df.columns if c in COORDS]
            df = df.unpivot(keep, [f"`{c}`" for c in df.columns if c not in keep], label, value)
        if spec.stack:
            a, b = spec.stack
            if any(df.schema[c].dataType.simpleString() == "string" for c in spec.stack):
                member = F.xxhash64(a, b)
            else:
                # A single number, the largest of the inner coordinate, comes back.
                member = F.col(a) * (df.agg(F.max(b)).first()[0] or 0) + F.col(a) + F.col(b)
            df = df.withColumn("_ens", member).drop(a, b).withColumnRenamed("_ens", "ens")
        if spec.keep_years:
            df = df.where(F.col("year").between(*spec.keep_years))
        coords = [c for c in COORDS if c in df.columns]
        fields = list(spec.fields) or [c for c in df.columns if c not in coords]
        fields = [c for c in fields if c not in spec.rates.values()]
        long = df.select(*coords, *[F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias(f) for f in fields]).unpivot(coords, [f"`{f}`" for f in fields], "field", "value")
    by = ["field", *[c for c in coords if c not in ("year", "month", "season")]]
    step = next((c for c in ("season", "month") if c in coords), None)
    if spec.seasonal and step == "month":
        long, step = resample.average_seasonally(long, by), "season"
    t = {"season": ta.season_to_decimal(F.col("year"), F.col("season")), "month": F.col("year") + (F.col("month") - 0.5) / 12}.get(step, F.col("year"))
    for c, rate in spec.rates.items():
        here = regress.time_derivative(long.where(F.col("field") == c).withColumn("_t", t.cast("double")), "_t", by)
        long = long.unionByName(here.select(*[F.lit(rate).alias("field") if x == "field" else (F.col("derivative") / SECONDS_A_YEAR).alias("value") if x == "value" else F.col(x) for x in long.columns]))
    if spec.sea_ice:
        over = [c for c in long.columns if c not in ("field", "value", "lat", "lon")]
        long = long.unionByName(_ice_totals(long, spec.sea_ice, over), allowMissingColumns=True)
    if spec.anomaly_period and anomalies:
        chosen = F.col("field").isin(*spec.anomalies) if spec.anomalies else F.lit(True)
        change = resample.anomalize(long.where(chosen), step, by, period=spec.anomaly_period, t=t)
        long = change.unionByName(long.where(~chosen)) if spec.anomalies else change
    return long


def load_evolv2k(spark: SparkSession, path: str, skip: int = 48) -> DataFrame:
    """Eruptions of year 1 and later: ``year, month, day, lat, vssi, sigma_vssi, asy, loc`` of a tab-separated text with ``skip`` lines and one of names before its rows."""
    names = ["year", "yearCE", "month", "day", "lat", "so4Greenland", "so4Antarctic", "vssi", "sigma_vssi", "asy", "loc", "tephra", "ref"]
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))
    cells = F.split("line", "\t")
    kinds = {"year": "int", "month": "int", "day": "int", "loc": "string"}
    keep = [n for n in names if n not in ("yearCE", "so4Greenland", "so4Antarctic", "tephra", "ref")]
    rows = lines.where((F.col("k") > skip) & (F.trim("line") != ""))
    return rows.select(*[F.trim(F.try_element_at(cells, F.lit(names.index(n) + 1))).try_cast(kinds.get(n, "double")).alias(n) for n in keep]).where("year >= 1")


def load_combined_eruptions(spark: SparkSession, early: str, late: str, vssi_min: float = 0.5) -> DataFrame:
    """Large eruptions since 850 of the text ``early`` and since 1900 of the table ``late`` (``utsvolcemis`` in kg of SO2, taken as Tg of sulphur)."""
    first = load_evolv2k(spark, early).drop("sigma_vssi", "asy").where("year >= 850")
    second = spark.read.parquet(late).withColumn("vssi", F.col("utsvolcemis") * 32.065 / 64.066 / 1e9).drop("utsvolcemis", "time_bnds", "depth", "height", "eruption_number")
    return combined_eruptions(first, second, vssi_min, 1900)


def combined_eruptions(early: DataFrame, late: DataFrame, threshold: float, late_from: int, column: str = "vssi") -> DataFrame:
    """Large eruptions of two catalogues, the later one from a year on."""
    return early.where((F.col(column) >= threshold) & (F.col("year") < late_from)).unionByName(late.where((F.col(column) >= threshold) & (F.col("year") >= late_from)), allowMissingColumns=True)


# -- sinks ------------------------------------------------------------------


def save_years(df: DataFrame, path: str, years_per_file: int = 100, single: bool = True) -> None:
    """Parquet partitioned by spans of years; fails if it exists. ``single``: values as float."""
    first = df.agg(F.min("year")).first()[0] or 0
    out = df.withColumn("span", F.floor((F.col("year") - first) / years_per_file).cast("int"))
    if single:
        out = out.withColumn("value", F.col("value").cast("float"))
    out.repartition("span", F.pmod(F.xxhash64("year"), F.lit(8))).write.mode("errorifexists").partitionBy("span").parquet(path)


def save_once(df: DataFrame, path: str) -> bool:
    """Writes unless a finished table is there; whether it wrote."""
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def save_states(df: DataFrame, path: str) -> None:
    """State rows by iteration and century, appended; states that are there already are refused."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        keys = [c for c in ("iteration", "year", "season", "month") if c in df.columns]
        again = spark.read.parquet(path).select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_semi").limit(1).collect()
        if again:
            raise ValueError(f"state {again[0].asDict()} is in {path} already")
    df.withColumn("century", F.floor(F.col("year") / 100).cast("int")).write.mode("append").partitionBy("iteration", "century").parquet(path)


def save_model(spark: SparkSession, path: str, text: str, meta: dict) -> None:
    """A model's JSON with its metadata, as a one-row table."""
    spark.createDataFrame([(text, json.dumps(meta))], "model string, metadata string").coalesce(1).write.mode("errorifexists").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[str, dict]:
    r = spark.read.parquet(path).first()
    return r["model"], json.loads(r["metadata"])


def describe_run(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of a saved model or run as ``key, value`` rows."""
    _, meta = load_model(spark, path)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(meta.items())] or [("", "")], "key string, value string")
