"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.queries import queries
from dialoom.session import local_session

HEADLINE = ("keyphrase_topk", "keyphrases", "summaries", "similar_docs", "similar_embeddings",
            "resolve_names", "speaker_labels", "page_text")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    timings = {}
    for name in HEADLINE:
        began = time.time()
        queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 2), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
