"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusfit import catalog  # noqa: E402
from corpusfit.catalog import views  # noqa: E402
from corpusfit.session import local_session  # noqa: E402

HEADLINE = (
    "leaderboard", "summary_counts", "skill_match_rates", "global_rank", "skill_gaps", "resolve_entities",
    "reconcile_sources", "experience_years", "burst_window", "search_text", "simhash", "near_dup_pairs",
    "dup_status", "segment", "dictionary_match", "tfidf_relevance", "jd_alignment", "match_skills",
    "score_documents", "score_requirements", "evaluate", "cross_reference", "graduation_year", "page_text",
    "rate_limit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, max(8, cpus), "16g")
    catalog.load_all()
    names = sys.argv[1:] or list(HEADLINE)
    catalog.QUERIES["leaderboard"](spark, folder).collect()  # starts the JVM's and Python's workers
    timings, stored = {}, {}
    for name in names:
        views.forget()  # every query makes the stored inputs that it reads within its own time
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        stored[name] = views.kept_names()
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "stored_inputs": stored, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
