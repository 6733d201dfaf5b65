"""Trained runs in a folder: written once, read back to score new rows.

A folder holds the run's tables (Parquet), its distribution fits and moments (JSON lines), the models in Spark's own
format, and a manifest that names them. The manifest is written last and its folder must be new, so a folder either has
a whole run or no manifest; a run that was broken off is told apart, not read in part.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession

from cohortflow.operators.dist import Fit
from cohortflow.operators.impute import KnnImputer
from cohortflow.plans.analysis import TargetRun, Variant
from cohortflow.sources.io import read_json, write_table

VERSION = 1
MODELS = {"GBTClassificationModel": GBTClassificationModel, "LogisticRegressionModel": LogisticRegressionModel}
FITS = "column string, family string, shapes array<double>, loc double, scale double, ks double, p_value double"
MOMENTS = "column string, mean double, sd double"
MANIFEST = "version int, name string, content string"
TABLES = ("train", "test", "scored")


def fits_table(spark: SparkSession, fits: dict[str, Fit | None]) -> DataFrame:
    """Fits as rows, every number unrounded; a column without a fit has no family."""
    rows = [(c, None, None, None, None, None, None) if f is None else (c, f.family, list(f.shapes), f.loc, f.scale, f.ks, f.p_value) for c, f in fits.items()]
    return spark.createDataFrame(rows, FITS)


def write_fits(spark: SparkSession, fits: dict[str, Fit | None], path: str) -> None:
    """As JSON lines, a column each."""
    write_table(fits_table(spark, fits), path, "json")


def read_fits(spark: SparkSession, path: str) -> dict[str, Fit | None]:
    # one row per column of a table
    rows = read_json(spark, path, FITS).collect()
    return {r["column"]: None if r["family"] is None else Fit(r["family"], tuple(r["shapes"] or ()), r["loc"], r["scale"], r["ks"], r["p_value"]) for r in rows}


def _write_imputer(imputer: KnnImputer, path: str) -> dict:
    write_table(imputer.donors, f"{path}/donors")
    for n, boxes in enumerate([*imputer.boxes, imputer.top_boxes]):
        write_table(boxes, f"{path}/boxes_{n}")
    return {
        "columns": imputer.columns, "key": imputer.key, "k": imputer.k, "block": imputer.block, "depth": imputer.depth,
        "top": imputer.top, "means": imputer.means, "levels": imputer.levels, "boxes": len(imputer.boxes),
    }


def _read_imputer(spark: SparkSession, path: str, state: dict) -> KnnImputer:
    imputer = KnnImputer(state["columns"], state["key"], state["k"], state["block"], state["depth"], state["top"])
    boxes = [spark.read.parquet(f"{path}/boxes_{n}") for n in range(state["boxes"] + 1)]
    return imputer.restore(state["means"], state["levels"], spark.read.parquet(f"{path}/donors"), boxes[:-1], boxes[-1])


def save_run(run: TargetRun, path: str) -> None:
    """Write a run to a new folder. Raises if the folder is there already."""
    spark, path = run.scored.sparkSession, path.rstrip("/")
    for name in TABLES:
        write_table(getattr(run, name), f"{path}/{name}")
    write_fits(spark, run.fits, f"{path}/fits")
    write_table(spark.createDataFrame([(c, float(m), float(s)) for c, (m, s) in run.moments.items()], MOMENTS), f"{path}/moments", "json")
    variants = {}
    for name, variant in run.variants.items():
        kind = type(variant.model).__name__
        if kind not in MODELS:
            raise ValueError(f"models of type {kind} cannot be stored")
        variant.model.write().save(f"{path}/models/{name}")
        variants[name] = {"kind": kind, "transform": variant.transform}
    content = {
        "label": run.label, "key": run.key, "features": run.features, "variants": variants, "settings": run.settings,
        "imputer": _write_imputer(run.imputer, f"{path}/imputer"),
    }
    write_table(spark.createDataFrame([(VERSION, "target_run", json.dumps(content))], MANIFEST).coalesce(1), f"{path}/manifest", "json")


def load_run(spark: SparkSession, path: str) -> TargetRun:
    """The run that :func:`save_run` has written. Raises ``ValueError`` where no whole run is."""
    path = path.rstrip("/")
    # the name of a folder alone is no proof that its writer has ended
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
        raise ValueError(f"no whole run in {path}")
    manifest = read_json(spark, f"{path}/manifest", MANIFEST).first()
    if manifest["version"] != VERSION or manifest["name"] != "target_run":
        raise ValueError(f"cannot read {manifest['name']} of version {manifest['version']}")
    content = json.loads(manifest["content"])
    variants = {n: Variant(MODELS[v["kind"]].load(f"{path}/models/{n}"), v["transform"]) for n, v in content["variants"].items()}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    moments = {r["column"]: (r["mean"], r["sd"]) for r in read_json(spark, f"{path}/moments", MOMENTS).collect()}
    return TargetRun(
        content["label"], content["key"], content["features"], tables["train"], tables["test"],
        _read_imputer(spark, f"{path}/imputer", content["imputer"]), variants, tables["scored"], read_fits(spark, f"{path}/fits"), moments, content["settings"],
    )
