"""Job entry points (also usable with ``spark-submit``)::

    python -m xgspark etl   --root OPEN_DATA --out SHOTS [--competition 43] [--format parquet|csv] [--store STORE]
    python -m xgspark train --shots SHOTS --model-out MODEL [--format parquet|csv] [--folds 5]
    python -m xgspark score --model MODEL --distance 11 --angle 37
    python -m xgspark score --model MODEL --requests REQUESTS --out SCORED

Each prints a one-line JSON summary.  Request tables need
``distance_meters`` and ``angle_degrees`` columns.
"""

from __future__ import annotations

import argparse
import json
import sys

from xgspark.config import DEFAULT_COMPETITION_ID, N_SPLITS


def _spark():
    from xgspark.session import build_session

    return build_session(app_name="xgspark-job")


def cmd_etl(a) -> dict:
    from xgspark.plans.etl import build_shots

    res = build_shots(_spark(), a.root, a.out, a.competition, a.format, store=a.store)
    summary = res.audit.first().asDict()
    if res.ledger is not None:
        by = res.ledger.groupBy("kind", "outcome").count().collect()
        summary["files"] = {f"{r['kind']} {r['outcome']}": r["count"] for r in sorted(by)}
    return summary


def cmd_train(a) -> dict:
    from xgspark.plans.training import train
    from xgspark.sources.shots_io import read_shots

    spark = _spark()
    rep = train(read_shots(spark, a.shots, a.format), a.model_out, a.folds)
    summary = rep.cv_summary.first().asDict()
    final = rep.final_model.first()
    summary.update(coef_distance=final.coef_distance, coef_angle=final.coef_angle,
                   intercept=final.intercept, rows_dropped=rep.rows_dropped,
                   shots=rep.n_rows, matches=rep.n_groups)
    return summary


def cmd_score(a) -> dict:
    from pyspark.sql import functions as F

    from xgspark.plans.scoring import score_batch
    from xgspark.sources.model_io import load_model

    spark = _spark()
    model = load_model(spark, a.model, on_missing="mark")
    if a.requests:
        reqs = spark.read.parquet(a.requests)
        scored = score_batch(reqs, model, validate=not a.no_validate)
        scored.withColumn("errors", F.to_json("errors")).write.mode("overwrite").parquet(a.out)
        counts = {r["status"]: r["count"] for r in scored.groupBy("status").count().collect()}
        return {"written": a.out, "status_counts": counts}
    reqs = spark.createDataFrame([(a.distance, a.angle)], "distance_meters double, angle_degrees double")
    r = score_batch(reqs, model, validate=not a.no_validate).first()
    if r.status != "ok":
        return {"status": r.status, "http_status": r.http_status, "errors": r.errors}
    return {"xg_probability": r.xg_probability, "distance_yards": r.distance_yards,
            "interpretation": r.interpretation}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="xgspark")
    sub = p.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("etl", help="open-data events -> clean shots")
    e.add_argument("--root", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--competition", type=int, default=DEFAULT_COMPETITION_ID)
    e.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    e.add_argument("--store", help="folder of parsed events kept between runs: only new and changed files are parsed")
    t = sub.add_parser("train", help="grouped CV + final model")
    t.add_argument("--shots", required=True)
    t.add_argument("--model-out", required=True)
    t.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    t.add_argument("--folds", type=int, default=N_SPLITS)
    s = sub.add_parser("score", help="score one shot or a request table")
    s.add_argument("--model", required=True)
    s.add_argument("--distance", type=float)
    s.add_argument("--angle", type=float)
    s.add_argument("--requests")
    s.add_argument("--out")
    s.add_argument("--no-validate", action="store_true",
                   help="score without the range checks (command-line behaviour)")
    a = p.parse_args(argv)
    if a.cmd == "score" and not a.requests and (a.distance is None or a.angle is None):
        p.error("score needs --requests/--out, or both --distance and --angle")
    if a.cmd == "score" and a.requests and not a.out:
        p.error("score --requests needs --out")
    try:
        out = {"etl": cmd_etl, "train": cmd_train, "score": cmd_score}[a.cmd](a)
    finally:
        from pyspark.sql import SparkSession

        from xgspark.session import clear_scratch

        if SparkSession.getActiveSession() is not None:
            clear_scratch(SparkSession.getActiveSession())
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
