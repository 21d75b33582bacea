"""python -m measured: truth, run, check, sample, summarize, compose, export, import."""

from __future__ import annotations

import argparse
import sys

from . import reports, runner
from .plans import bricks, compose, questions
from .session import session
from .sources import tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="measured")
    c = p.add_subparsers(dest="what", required=True)
    for name in ("truth", "run", "check"):
        a = c.add_parser(name)
        a.add_argument("folder", help="folder of the tables")
        a.add_argument("out", help="Parquet table to write")
        a.add_argument("--only", nargs="*", help="names of questions")
        if name != "truth":
            a.add_argument("--expected", required=True, help="table written by truth")
    c.add_parser("summarize").add_argument("results")
    a = c.add_parser("compose")
    a.add_argument("template")
    a.add_argument("--search", nargs="*", default=[])
    for name in ("export", "import"):
        a = c.add_parser(name)
        a.add_argument("source")
        a.add_argument("target")
        a.add_argument("--kind", choices=["expected", "results"], required=True)
    a = c.add_parser("sample", help="a declared quick check: its questions answered twice alike")
    a.add_argument("file", help="JSON of samples")
    a.add_argument("name")
    a.add_argument("--lock", default=".measured.lock", help="file that lets one check run at a time")
    o = p.parse_args(argv)
    if o.what == "compose":
        print(compose.compose(o.template, o.search))
        return 0
    spark = session()
    kinds = {"expected": (runner.EXPECTED, ["question"]), "results": (runner.RESULTS, ["question", "target", "phase", "rep"])}
    if o.what in ("export", "import"):
        schema, keys = kinds[o.kind]
        if o.what == "export":
            tables.export_tsv(tables.read_typed(spark, schema, o.source), keys, o.target)
        else:
            tables.write_typed(tables.import_tsv(spark, schema, o.source), schema, o.target)
        return 0
    if o.what == "summarize":
        s = runner.summarise(tables.read_typed(spark, runner.RESULTS, o.results))
        s.orderBy("question", "target", "phase").show(1000, truncate=False)
        return runner.status(s)
    all_ = questions.QUERIES | bricks.QUERIES
    if o.what == "sample":
        s = reports.samples(o.file)[o.name]
        with reports.alone(o.lock):
            try:
                runner.truth(spark, s["folder"], {k: all_[k] for k in s["questions"]}).show(truncate=False)
            except runner.Unsteady as e:
                print(f"{e} answers differently twice")
                return runner.STATUS["WRONG"]
        return 0
    own = {k: all_[k] for k in o.only or all_}
    if o.what == "truth":
        tables.write_typed(runner.truth(spark, o.folder, own), runner.EXPECTED, o.out)
        return 0
    expected = tables.read_typed(spark, runner.EXPECTED, o.expected)
    found = runner.run(spark, o.folder, {"own": own}, expected, *((1, 3) if o.what == "run" else (0, 1)))
    tables.write_typed(found, runner.RESULTS, o.out)
    return runner.status(runner.summarise(tables.read_typed(spark, runner.RESULTS, o.out)))


if __name__ == "__main__":
    sys.exit(main())
