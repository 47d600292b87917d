"""python -m citegraph build ROOT INDEX | search INDEX QUERY | ask INDEX QUESTION | evaluate QUESTIONS REPORT"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from citegraph.plans import evaluate
from citegraph.plans.agent import Answerer
from citegraph.plans.index import MODES, Index
from citegraph.sources.files import write_report


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    todo = parser.add_subparsers(dest="do", required=True)
    for name, what in (("build", "root"), ("search", "query"), ("ask", "question")):
        one = todo.add_parser(name)
        for argument in (what, "index") if name == "build" else ("index", what):
            one.add_argument(argument)
        if name == "search":
            one.add_argument("--mode", choices=MODES, default="hybrid")
    one = todo.add_parser("evaluate")
    one.add_argument("questions")
    one.add_argument("report")
    one.add_argument("--base", default=".", help="where the roots of the question set's repositories begin")
    one.add_argument("--top-k", type=int, default=10)
    one.add_argument("--skip-agent", action="store_true")
    one.add_argument("--diffs", help="a diff benchmark in JSON lines")
    one.add_argument("--checkouts", help="a folder with a checkout for each instance")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("citegraph").getOrCreate()
    if given.do == "build":
        index = Index.build(spark, given.root)
        index.save(given.index)
        print(json.dumps(index.manifest, indent=2))
    elif given.do == "search":
        print(json.dumps(Index.load(spark, given.index).search(given.query, given.mode), indent=2))
    elif given.do == "evaluate":
        report = evaluate.report(spark, given.questions, given.base, given.top_k, not given.skip_agent, given.diffs, given.checkouts)
        write_report(report, given.report)
        print(json.dumps({k: report[k] for k in ("questions", "invalid_gold")}, indent=2, default=str))
    else:
        print(json.dumps(Answerer(Index.load(spark, given.index)).answer(given.question).to_dict(), indent=2, default=str))


if __name__ == "__main__":
    main()
