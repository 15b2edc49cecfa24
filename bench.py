"""Times the headline queries and prints one line of JSON.

Search times are for a batch of every hundredth vector over indexes that are built
first; build times are apart. recall is against exhaustive search; scored is how many
documents a query scores in full, on average. BENCH_SF_DIR and BENCH_CPUS set the
tables and the number of cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Sized for lists of about a thousand postings.
LAM, BETA, ALPHA, CUT = 400, 20, 0.4, 3


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lumenta import queries as q
    from lumenta.operators import clusters, postings, score, search
    from lumenta.scratch import scratch
    from lumenta.types import SearchParameters

    times: dict[str, float] = {}

    def timed(name: str, make) -> DataFrame:
        make().write.format("noop").mode("overwrite").save()  # compiled and read once before
        began = time.time()
        df = make()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        return df

    began = time.time()
    entries = scratch(q.embeddings(spark, SF_DIR).sort("doc_id"), "bench-vectors")
    times["load"] = round(time.time() - began, 3)
    began = time.time()
    members = scratch(clusters.assigned(postings.pruned(entries, LAM), entries, BETA), "bench-members")
    summaries = scratch(clusters.summaries(members, entries, ALPHA), "bench-summaries")
    times["build_clusters"] = round(time.time() - began, 3)
    began = time.time()
    codes = scratch(entries.withColumn("value", q.Q8.encode(F.col("value"))), "bench-codes")
    stats = scratch(postings.term_stats(entries), "bench-stats")
    times["build_codes"] = round(time.time() - began, 3)
    batch = q.batch(entries)
    code_batch = batch.withColumn("weight", q.Q8.encode(F.col("weight")))
    index = {"vectors": entries, "members": members, "summaries": summaries}
    n = batch.select("qid").distinct().count()
    mean = lambda pairs: round(pairs.count() / n, 1)
    cut = postings.query_cut(batch, CUT)
    scores = clusters.summary_scores(cut, batch, summaries)
    scored = {"documents": entries.select("doc_id").distinct().count(), "inverted": mean(score.products(entries, batch)), "exhaustive": mean(cut.select("qid", "term").join(members, "term").select("qid", "doc_id").distinct())}
    recall = {}
    for k in (10, 100):
        truth = timed(f"brute_k{k}", lambda k=k: search.brute(entries, batch, k))
        timed(f"inverted_k{k}", lambda k=k: search.inverted(entries, batch, k))
        timed(f"maxscore_k{k}", lambda k=k: search.maxscore(entries, stats, batch, k))
        scored[f"maxscore_k{k}"] = mean(search.essential(entries, stats, batch, k))
        scored[f"setwise_k{k}"] = mean(search.surviving(scores, cut, members, entries, batch, k, 1.0))
        timed(f"codes_k{k}", lambda k=k: search.quantized(codes, code_batch, q.Q8, q.Q8, k))
        for mode in ("exhaustive", "setwise"):
            found = timed(f"clustered_{mode}_k{k}", lambda k=k, mode=mode: search.clustered(index, batch, k, SearchParameters(CUT, 1.0, mode)))
            recall[f"{mode}_k{k}"] = round(search.recall(found, truth).agg(F.avg("recall")).first()[0], 4)
    timed("doc_lex_topk", lambda: q.doc_lex_topk(spark, SF_DIR))
    print(json.dumps({"metric": "seconds of all queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "recall": recall, "scored": scored, "batch": n, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
