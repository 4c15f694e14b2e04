"""Command line: run, hunt, bench, demo, lexicon, doctor, version.

Exit codes: 0 done, 1 no telemetry that can be read, 2 no such path.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tamarack import evaluate, hunt, lexicon, schemas, synth
from tamarack.operators import host
from tamarack.plans import correlate
from tamarack.plans.context import DETECTORS, Context, all_findings
from tamarack.plans.findings import VERSION
from tamarack.receipt import metered
from tamarack.runtime import materialize
from tamarack.sources.capture import load_capture


def session() -> SparkSession:
    return SparkSession.builder.appName("tamarack").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _counts(ctx: Context) -> dict[str, int]:
    return {n: getattr(ctx, n).count() for n in schemas.BY_NAME}


def _queue(ctx: Context, top: int, detectors: str | None = None) -> tuple[list[dict], int]:
    """The first incidents of the queue as dictionaries, and the number of findings; only these rows reach the driver."""
    found = materialize(all_findings(ctx, tuple(detectors.split(",")) if detectors else DETECTORS), "findings")
    rows = correlate.queue(found).orderBy("place").limit(top).collect()
    return [r.asDict(recursive=True) for r in rows], found.count()


def _show(incidents: list[dict]) -> None:
    for i in incidents:
        print(f"{i['place']:>3}  {i['priority']:.3f}  {i['severity']:<8}  {i['title']}")
        print(f"     {i['rationale']}")
        for f in i["findings"][:4]:
            target = f" {f['object']['value']}" if f["object"] else ""
            print(f"     - {f['subject']['value']} {f['predicate']}{target} ({f['confidence']:.2f}) [{f['id']}]")


def _load(spark: SparkSession, path: str) -> tuple[Context | None, int]:
    if not Path(path).exists():
        print(f"no such path: {path}", file=sys.stderr)
        return None, 2
    ctx, rejected = load_capture(spark, path, spark.createDataFrame([(w,) for w in synth.words()], "word string"))
    for file, line, text in rejected:
        print(f"rejected {file}:{line}: {text}", file=sys.stderr)
    if not any(_counts(ctx).values()):
        print("no telemetry that can be read", file=sys.stderr)
        return None, 1
    return ctx, 0


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    ctx, code = _load(spark, args.path)
    if ctx is None:
        return code
    with metered(spark) as receipt:
        receipt.records = _counts(ctx)
        incidents, receipt.findings = _queue(ctx, args.top, args.detectors)
        receipt.incidents = len(incidents)
    if args.json:
        print(json.dumps({"incidents": incidents, "receipt": receipt.as_dict()}, default=str))
    else:
        _show(incidents)
        print(json.dumps(receipt.as_dict()))
    return 0


def hunts(spark: SparkSession, args: argparse.Namespace) -> int:
    ctx, code = _load(spark, args.path)
    if ctx is None:
        return code
    wanted = tuple(hunt.Dialect(d) for d in args.dialect) if args.dialect else tuple(hunt.Dialect)
    queries = [q for i in _queue(ctx, args.top, args.detectors)[0] for q in hunt.queries_for_incident(i, wanted)]
    for n, q in enumerate(queries):
        if args.out:
            target = Path(args.out)
            target.mkdir(parents=True, exist_ok=True)
            (target / f"{n:04d}-{q.dialect.value}.txt").write_text(q.query + "\n", encoding="utf-8")
        else:
            print(f"--- {q.title} [{q.dialect.value}]\n{q.query}\n")
    return 0


def bench(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.real:
        from tamarack.sources.netflow import load_netflow

        if not Path(args.real).exists():
            print(f"no such path: {args.real}", file=sys.stderr)
            return 2
        print(json.dumps(evaluate.evaluate_labelled(spark, load_netflow(spark, args.real)), default=str))
        return 0
    for name in synth.CORPORA:
        s = evaluate.run_corpus(spark, name, args.seed)
        print(f"{name:<10} precision {s.precision:.3f} recall {s.recall:.3f} f1 {s.f1:.3f} ({s.tp} found, {s.fp} false, {s.fn} missed)")
    return 0


def demo(spark: SparkSession, args: argparse.Namespace) -> int:
    _show(_queue(Context.of(spark, **synth.demo(spark)), args.top)[0])
    return 0


def show_lexicon(spark: SparkSession, args: argparse.Namespace) -> int:
    for rule in lexicon.GRAMMAR:
        print(f"{rule.predicate}: {'|'.join(rule.subjects)} -> {'|'.join(rule.objects) if rule.objects else '(nothing)'}; {rule.severity}; {', '.join(rule.techniques) or '-'}")
    return 0


def _silence(name: str, df: DataFrame, ctx: Context) -> str:
    """Why a source may be silent: no data, too little for its detectors, or enough."""
    n = df.count()
    if not n:
        return "no data"
    if name == "processes":
        summed = host.edges(host.named(df))
        if host.gated(summed, ctx.configs.host).isEmpty():
            return f"insufficient: the estate can't support a claim of rarity ({n} records)"
    least = {"connections": ctx.configs.beaconing.min_connections, "dns": ctx.configs.dnstunnel.min_queries, "alerts": ctx.configs.alerts.min_alerts, "ssl": ctx.configs.tlsdga.min_estate_hosts}
    return f"insufficient: {n} records" if n < least.get(name, 1) else f"sufficient: {n} records"


def doctor(spark: SparkSession, args: argparse.Namespace) -> int:
    print(f"tamarack {VERSION}, Spark {spark.version}, {spark.sparkContext.defaultParallelism} cores")
    if args.telemetry:
        ctx, code = _load(spark, args.telemetry)
        if ctx is None:
            return code
        for name in schemas.BY_NAME:
            print(f"{name}: {_silence(name, getattr(ctx, name), ctx)}")
    return 0


def version(spark: SparkSession | None, args: argparse.Namespace) -> int:
    print(VERSION)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tamarack", description=__doc__)
    subs = top.add_subparsers(required=True)
    for name, f, help_ in (("run", run, "detect and rank"), ("hunt", hunts, "searches for what was found"), ("bench", bench, "detectors against planted truth"), ("demo", demo, "a synthetic capture"), ("lexicon", show_lexicon, "what can be said"), ("doctor", doctor, "what a capture can support"), ("version", version, "the version")):
        p = subs.add_parser(name, help=help_)
        p.set_defaults(func=f)
        if name in ("run", "hunt"):
            p.add_argument("path")
            p.add_argument("--detectors", help=f"some of {','.join(DETECTORS)}; all by default")
        if name in ("run", "hunt", "demo"):
            p.add_argument("--top", type=int, default=20)
        if name == "run":
            p.add_argument("--json", action="store_true")
        if name == "hunt":
            p.add_argument("--dialect", action="append", choices=[d.value for d in hunt.Dialect])
            p.add_argument("--out")
        if name == "bench":
            p.add_argument("--real")
            p.add_argument("--seed", type=int, default=1337)
        if name == "doctor":
            p.add_argument("--telemetry")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.func(spark or (session() if args.func not in (version, show_lexicon) else None), args)


if __name__ == "__main__":
    sys.exit(main())
