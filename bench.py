"""Headline timings. Prints one JSON line.

Every step runs in full on the tables in $BENCH_SF_DIR with $BENCH_CPUS cores. Steps that later ones
build on (index, candidates, features) are timed on their own, once, and then shared.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.compare import session  # noqa: E402
from checks.queries import CONFIG, collection  # noqa: E402
from rankloom.operators import bm25, evaluation, search  # noqa: E402
from rankloom.operators.diagnostics import spearman_matrix  # noqa: E402
from rankloom.plans.experiment import Experiment  # noqa: E402
from rankloom.schemas import FEATURE_COLUMNS  # noqa: E402


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    start = time.perf_counter()
    given = collection(spark, folder)  # matches and writes the judgements
    run = Experiment(given, CONFIG)
    assert run.qrels is not None
    seconds = {"passage_qrels": round(time.perf_counter() - start, 3)}
    steps = {
        "sample_and_split": lambda: run.split,
        "bm25_index": lambda: run.index,
        "bm25_topk_all_queries": lambda: drain(bm25.top_k(run.index, given.queries, CONFIG.bm25_top_k)),
        "candidates_and_pairs": lambda: run.pairs,
        "tfidf_vocabulary": lambda: run.vocabulary,
        "feature_frame": lambda: run.frame,
        "spearman_matrix": lambda: drain(spearman_matrix(run.train, FEATURE_COLUMNS)),
        "tuning_6x5_fits": lambda: run.tuning,
        "feature_selection": lambda: run.selection,
        "final_fit": lambda: run.model,
        "score_and_alpha_grid": lambda: run.alpha,
        "model_comparison": lambda: run.metrics,
        "evaluate_bm25": lambda: drain(evaluation.evaluate_run(run.runs()["bm25"], run.qrels, run.split)),
        "search_hybrid_all_queries": lambda: drain(
            search.search_hybrid(
                run.index, run.index.texts, given.queries, run.vocabulary, run.model, run.alpha
            )
        ),
    }
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "ranking_run_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
