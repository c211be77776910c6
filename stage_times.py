"""Per-stage wall times of the headline jobs from Spark's event log
(python stage_times.py [sf_dir]); the log goes to a fresh scratch folder."""

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = sys.argv[1] if len(sys.argv) > 1 else os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main():
    from pyspark.sql import SparkSession
    log_dir = tempfile.mkdtemp(prefix="washbay-eventlog-")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "16")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false")
             .config("spark.eventLog.dir", log_dir).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from washbay.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    from washbay.operators import attendance as AT, codes as CO, intake as I, packs as PK, people as PE
    from washbay.plans import reports as P
    from washbay.sources.fixtures import fixture

    def run(dfs):
        for df in dfs:
            df.write.format("noop").mode("overwrite").save()

    jobs = {
        "a13_stats_report": lambda: run(P.stats_report(fixture(spark, SF_DIR, "bookings"), "month").values()),
        "a14_growth_report": lambda: run(P.growth_report(fixture(spark, SF_DIR, "bookings"), "2001-08-01").values()),
        "j1_price_bookings": lambda: run([I.price_bookings(fixture(spark, SF_DIR, "booking_requests"),
                                                           fixture(spark, SF_DIR, "catalog"))]),
        "w7_pair_attendance": lambda: run([AT.pair_attendance(PE.known_employees(
            fixture(spark, SF_DIR, "attendance_events"), fixture(spark, SF_DIR, "users"))[0])]),
        "w8_wash_ledger": lambda: run([PK.wash_ledger(fixture(spark, SF_DIR, "memberships"), fixture(spark, SF_DIR, "washes"))]),
        "w10_code_cooldown": lambda: run([CO.code_cooldown(fixture(spark, SF_DIR, "code_requests"))]),
    }
    for name, fn in jobs.items():
        spark.sparkContext.setJobDescription(name)
        fn()
    spark.stop()

    stage_job, job_desc, stage_time, stage_name = {}, {}, {}, {}
    for path in [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]:
        with open(path) as f:
            for line in f:
                e = json.loads(line)
                ev = e.get("Event")
                if ev == "SparkListenerJobStart":
                    job_desc[e["Job ID"]] = (e.get("Properties") or {}).get("spark.job.description", "?")
                    for sid in e.get("Stage IDs", []):
                        stage_job[sid] = e["Job ID"]
                elif ev == "SparkListenerStageCompleted":
                    info = e["Stage Info"]
                    if "Completion Time" in info and "Submission Time" in info:
                        stage_time[info["Stage ID"]] = info["Completion Time"] - info["Submission Time"]
                        stage_name[info["Stage ID"]] = info["Stage Name"].split(" at ")[0]
    per = defaultdict(list)
    for sid, ms in stage_time.items():
        per[job_desc.get(stage_job.get(sid), "?")].append((ms, sid, stage_name[sid]))
    for name in jobs:
        stages = sorted(per.get(name, []), reverse=True)
        total = sum(ms for ms, _, _ in stages)
        top = ", ".join(f"{n}#{sid} {ms} ms" for ms, sid, n in stages[:4])
        print(f"{name}: {len(stages)} stages, {total} ms stage time; slowest: {top}")


if __name__ == "__main__":
    main()
