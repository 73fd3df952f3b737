"""Command line: one sub-command for each pipeline. A failed gate writes its report and ends with status 1."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import adapters, gates, images, relations
from .packages import ship
from .plans.staging import discard, written
from .schema import CANONICAL, ColumnMapping
from .sources import files, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("lumenframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _text(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON, for CSV."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))


def discover(spark, a):
    df = files.load_table(spark, a.input)
    found = adapters.find_candidates(df)
    print("\n".join(f"{field}: {', '.join(names) or '-'}" for field, names in found.items()))
    return {"rows": df.count(), "columns": df.columns, "candidates": found}, True


def canonicalize(spark, a):
    out = adapters.build_canonical(files.load_table(spark, a.input), ColumnMapping.from_yaml(a.mapping), a.dataset, a.biomarker, a.unit)
    report = sinks.report_dict(gates.passed(out, gates.canonical_rules()))
    if report["passed"]:
        sinks.write_csv(out, a.output)
    return report, report["passed"]


def _split_clean(df: DataFrame) -> tuple[bool, str | None]:
    """Whether patients of each biomarker can be split without overlap, and why not."""
    try:
        split_ = relations.split_by(df)
        relations.require_disjoint(split_.withColumn("_key", F.concat_ws("|", "biomarker", "patient_id")), "partition", "_key")
    except Exception as e:  # noqa: BLE001 - any failure is a failed check
        return False, str(e)[:500]
    return True, None


def audit(spark, a):
    """Fails unless every image is there, can be decoded, isn't a copy, was measured and is of usable quality, and patients can be split."""
    df = gates.completed(files.load_table(spark, a.input), CANONICAL)
    report = {"canonical": sinks.report_dict(gates.passed(df, gates.canonical_rules())), "ready": False}
    if not report["canonical"]["passed"]:
        return report, False
    sinks.write_csv(relations.missingness(df), f"{a.output}/missingness")
    sinks.write_csv(relations.target_summary(df), f"{a.output}/target_summary")
    report["leakage"] = sinks.report_dict(relations.leakage_report(df))
    clean, report["split_error"] = _split_clean(df)
    if a.root:
        inv = written(files.inventory(spark, df, a.root), "inventory")
        audited = written(images.quality_audit(files.read_images(spark, a.root)), "audited")
        asked = inv.select(files.resolved(F.col("image_path"), a.root).alias("path")).distinct()
        audited = asked.join(audited, "path", "left").withColumn("quality_error", F.when(F.col("brightness_ok").isNull() & F.col("quality_error").isNull(), "the file is missing or no image").otherwise(F.col("quality_error")))
        sinks.write_csv(inv, f"{a.output}/inventory")
        sinks.write_csv(relations.duplicate_rows(inv.where("sha256 is not null"), "sha256"), f"{a.output}/duplicates")
        sinks.write_csv(audited, f"{a.output}/quality")
    else:  # no files were seen, so nothing is known of them
        inv = spark.createDataFrame([], "exists boolean, readable boolean, sha256 string")
        audited = spark.createDataFrame([], "quality_error string, " + ", ".join(f"{c} boolean" for c in images.AUDIT_FLAGS))
    checks = written(images.audit_checks(inv, audited, clean), "checks")
    report["checks"] = {r["name"]: r["ok"] for r in checks.collect()}
    report["ready"] = sinks.report_dict(relations.audit_gate(checks))["passed"]
    return report, report["ready"]


def split(spark, a):
    out = relations.split_by(files.load_table(spark, a.input, texts=["patient_id"]), seed=a.seed)
    sinks.write_csv(out, a.output, ["biomarker", "partition"])
    return {r["partition"]: r["n"] for r in out.groupBy("partition").agg(F.count("*").alias("n")).collect()}, True


def _regions(spark, a, what: str, **how) -> DataFrame:
    """Metadata rows with the measurement of their image's region, or the reason why there is none."""
    meta = files.load_table(spark, a.input, texts=["patient_id", "image_id"]).withColumn("_path", files.resolved(F.col("image_path"), a.root))
    boxes = gates.completed(meta, images.BOX).select(F.col("_path").alias("path"), *images.BOX).dropDuplicates(["path"])
    found = images.measured(files.read_images(spark, a.root), (what,), None if getattr(a, "centre", None) else boxes, getattr(a, "centre", None), **how)
    found = found.select(F.col("path").alias("_path"), F.col("error").alias("_error"), F.col(what).alias("_found"), F.lit(True).alias("_seen"))
    j = meta.join(found, "_path", "left")
    error = F.when(F.col("_seen").isNull(), "the file is missing or no image").otherwise(F.col("_error"))
    return j.select(*(c for c in meta.columns if c != "_path"), "_found.*", error.alias("feature_error"))


def features(spark, a):
    """Features of each image's region; a centre region has to be asked for and is for demonstrations only."""
    out = written(_regions(spark, a, "features"), "features")
    sinks.write_csv(_text(out), a.output)
    report = sinks.report_dict(out.agg(F.count("*").alias("rows"), F.count("feature_error").alias("failed")))
    return report, report["rows"] > 0


def physics_audit(spark, a):
    df = gates.completed(files.load_table(spark, a.input), CANONICAL)
    sinks.write_csv(_text(gates.checked(df, gates.physics_rules(a.require_raw))), a.output)
    report = sinks.report_dict(gates.passed(df, gates.physics_rules(a.require_raw)))
    return report, report["passed"]


def participant_preflight(spark, a):
    report = sinks.report_dict(gates.participant_preflight(files.load_table(spark, a.input)))
    return report, report["passed"]


def video_preflight(spark, a):
    report = sinks.report_dict(gates.video_preflight(files.load_table(spark, a.input)))
    return report, report["passed"]


def video_validate(spark, a):
    manifest = files.load_table(spark, a.input).withColumn("row_id", F.monotonically_increasing_id())
    out = written(files.inspect_videos(spark, manifest, a.root), "videos")
    sinks.write_records(out, f"{a.output}/records")
    report = sinks.report_dict(out.agg(F.count("*").alias("rows"), F.count_if("exists").alias("found"), F.count_if("readable").alias("readable"), F.count("duplicate_of").alias("duplicate_files")))
    return report, report["rows"] > 0 and report["readable"] == report["rows"] and not report["duplicate_files"]


def ingest_participants(spark, a):
    out = adapters.adapt_participants(files.load_table(spark, a.input), a.modalities or adapters.MODALITIES)
    n = out.count()
    if n:
        sinks.write_csv(out, a.output)
    return {"rows": n}, n > 0


def experimental_intake(spark, a):
    df = files.load_table(spark, a.input)
    rules = gates.intake_rules(a.biomarker, a.unit)
    report = sinks.report_dict(gates.passed(df, rules))
    report["repeated_images"] = gates.repeated(df, "image_id").count()
    report["rules"] = {r["rule"]: r["n"] for r in gates.verdict(df, rules).where("n > 0").collect()}
    if a.root:
        inv = files.inventory(spark, df, a.root)
        report |= sinks.report_dict(inv.agg(F.count_if(~F.col("exists")).alias("missing_files"), (F.count("sha256") - F.count_distinct("sha256")).alias("repeated_files")))
    ok = report["passed"] and not report["repeated_images"] and not report.get("missing_files") and not report.get("repeated_files")
    return report, ok


def optical_audit(spark, a):
    out = written(_regions(spark, a, "region"), "regions")
    sinks.write_csv(_text(out), a.output)
    report = sinks.report_dict(relations.status_counts(out, F.coalesce("status", F.lit("ERROR")), ("PASS", "FAIL", "ERROR")))
    return report, report["n"] > 0 and report["pass"] == report["n"]


def scientific_experiment(spark, a):
    from .plans.experiments import ExperimentConfig, scientific_experiment as run  # noqa: I001

    parts = [files.load_table(spark, p) for p in (a.train, a.calibration, a.test)]
    config = ExperimentConfig(tuple(a.features.split(",")), a.biomarker, a.unit, a.model, a.alpha, a.max_interval_width, a.n_bootstrap, a.n_permutations, a.seed)
    report = run(*parts, config)
    return report, report["passed"]


def quality(spark, a):
    """Fails where there is no image, or one that can't be decoded."""
    given = {}
    if a.config:
        import yaml

        with open(a.config, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
    limits = images.QualityLimits(**given)
    found = images.measured(files.read_images(spark, a.root), ("quality",), quality_limits=limits).select("path", "width", "height", F.col("quality.*"), F.col("error").alias("_error"))
    out = files.list_images(spark, a.root).select("path").join(found, "path", "left").withColumn("quality_error", F.when(F.col("quality_status").isNull(), F.coalesce("_error", F.lit("the image can't be decoded")))).drop("_error")
    out = written(out, "quality")
    sinks.write_csv(out, a.output)
    report = sinks.report_dict(relations.status_counts(out, F.coalesce("quality_status", F.lit("ERROR")), ("PASS", "REVIEW", "FAIL", "ERROR")))
    return report, report["n"] > 0 and not report["error"]


def ingest_neonatal(spark, a):
    """A neonatal export as canonical rows; files named but missing fail, and so does an export without rows."""
    out = adapters.neonatal_images(files.load_table(spark, a.input, texts=["patient_id", "image_idx"]), files.list_images(spark, a.root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")))
    out = written(out, "rows")
    n = out.count()
    if n:
        sinks.write_csv(out, a.output)
    return {"rows": n}, n > 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenframe")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for o, how in (*options, ("--report", {})):
            c.add_argument(o, **how)

    need, plain = {"required": True}, {}
    what = [("--biomarker", {"default": "hemoglobin"}), ("--unit", {"default": "g/dL"})]
    add("discover", discover, ("--input", need))
    add("canonicalize", canonicalize, ("--input", need), ("--mapping", need), ("--dataset", need), ("--output", need), *what)
    add("audit", audit, ("--input", need), ("--output", need), ("--root", plain))
    add("split", split, ("--input", need), ("--output", need), ("--seed", {"type": int, "default": 42}))
    add("features", features, ("--input", need), ("--root", need), ("--output", need), ("--centre", {"type": float, "help": "share of each side of a centre region instead of given ones; for demonstrations only"}))
    add("physics-audit", physics_audit, ("--input", need), ("--output", need), ("--require-raw", {"action": "store_true"}))
    add("participant-preflight", participant_preflight, ("--input", need))
    add("video-preflight", video_preflight, ("--input", need))
    add("video-validate", video_validate, ("--input", need), ("--root", need), ("--output", need))
    add("ingest-participants", ingest_participants, ("--input", need), ("--output", need), ("--modalities", {"nargs": "*"}))
    add("ingest-neonatal", ingest_neonatal, ("--input", need), ("--root", need), ("--output", need))
    add("experimental-intake", experimental_intake, ("--input", need), ("--root", plain), ("--biomarker", plain), ("--unit", plain))
    add("optical-audit", optical_audit, ("--input", need), ("--root", need), ("--output", need))
    add("scientific-experiment", scientific_experiment, ("--train", need), ("--calibration", need), ("--test", need), ("--features", need), ("--model", {"default": "ridge"}), ("--alpha", {"type": float, "default": 0.10}), ("--max-interval-width", {"type": float}), ("--n-bootstrap", {"type": int, "default": 2000}), ("--n-permutations", {"type": int, "default": 2000}), ("--seed", {"type": int, "default": 42}), *what)
    add("quality", quality, ("--root", need), ("--output", need), ("--config", plain))
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    if not spark.sparkContext.master.startswith("local["):
        ship(spark)
    try:
        report, ok = args.run(spark, args)
    finally:
        discard(spark)  # what a command wrote to shared storage on its way
    if args.report:
        sinks.write_report(report, args.report)
    print(f"{args.command}: {'passed' if ok else 'failed'}")
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
