"""Headline benchmark: prints one JSON line.

Queries (SURVEY §6 bench target): feature engineering (E7), velocity windows
(W2), isolation-forest fit + score (M6), the evaluation tournament (V11) over
rule + isolation-forest scores, and the threshold sweep (V6).  Each query is
fully computed with the `noop` sink (no driver collect).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from txsentinel.operators import evaluate as ev  # noqa: E402
from txsentinel.operators.detectors.iforest import IsolationForestDetector  # noqa: E402
from txsentinel.operators.detectors.rule import all_rule_scores  # noqa: E402
from txsentinel.operators.features import add_velocity_features, engineer_features  # noqa: E402
from txsentinel.operators.ordered import positional_split_by_cut  # noqa: E402
from txsentinel.plans import flow as P  # noqa: E402
from txsentinel.session import get_session, materialize  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                        extra_conf={"spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    # warm-up (JVM, codegen caches, Python workers for the pandas UDFs); not timed
    run(P.labelled(spark, "/root/testdata/sf0.001"))
    warm = spark.range(64 * cpus).repartition(cpus)
    warm.mapInPandas(lambda it: (pdf for pdf in it), "id long").write.format("noop") \
        .mode("overwrite").save()

    t = time.time()
    labelled = P.labelled(spark, sf_dir, persist=True)  # the raw table, written once
    times["inject_anomalies"] = time.time() - t

    t = time.time()
    feats = materialize(engineer_features(labelled), "features")
    times["engineer_features"] = time.time() - t

    t = time.time()
    run(add_velocity_features(labelled).select("tx_id", "tx_frequency_1h", "tx_frequency_24h"))
    times["velocity_features"] = time.time() - t

    t = time.time()
    split = positional_split_by_cut(feats, list(P.SPLIT_ORDER))
    times["temporal_split"] = time.time() - t

    train = split.where(F.col("is_train") == 1)
    test = split.where(F.col("is_train") == 0)
    t = time.time()
    det = IsolationForestDetector().fit(train)
    iso = materialize(det.score(test), "iso_scores")
    times["iforest_fit_score"] = time.time() - t

    t = time.time()
    scores = all_rule_scores(test).unionByName(iso)
    run(ev.tournament(scores))
    times["tournament"] = time.time() - t

    t = time.time()
    run(ev.threshold_sweep(scores))
    times["threshold_sweep"] = time.time() - t

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    total = sum(times.values())
    print(json.dumps({"metric": "headline_seconds", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()},
                      "sf": float(sf.group(1)) if sf else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
