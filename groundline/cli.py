"""The command line: every operation, with JSON on standard output. Exit codes: 0 done, 1 an expected answer failed, 2 an unhealthy snapshot or an error."""
import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import bundle, serve, tools
from .plans import bootstrap, compile, extract, golden
from .sources.jsonl import BundleError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="groundline", description="Evidence-bounded dependency graphs.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args, **options):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for k, kw in options.items():
            s.add_argument("--" + k.replace("_", "-"), **kw)
    hops = lambda n: dict(type=int, default=n)
    for name in ("airflow", "init"):
        add(name, "source", output=dict(required=True), namespace=dict(required=True))
    add("example", "output")
    add("demo", "output")
    add("build", "spec", output=dict(required=True), snapshot_id={})
    add("bootstrap", "root", output=dict(default=".groundline/graph"), spec={})
    add("doctor", "bundle")
    add("find", "bundle", "query", node_type={}, limit=hops(10))
    for name in ("upstream", "downstream"):
        add(name, "bundle", "node_id", max_hops=hops(6))
    add("path", "bundle", "source_node_id", "target_node_id", max_hops=hops(8))
    add("impact", "bundle", "node_id", max_hops=hops(6), change_type=dict(default="unspecified"))
    add("mcp", "bundle", transport=dict(choices=("stdio", "http"), default="stdio"), host=dict(default="127.0.0.1"), port=hops(8000))
    add("eval", "bundle", "golden")
    return p


EXAMPLE = '''from airflow import DAG
from airflow.operators.empty import EmptyOperator
from airflow.sensors.external_task import ExternalTaskSensor

with DAG("sales_load", schedule="@daily"):
    read = EmptyOperator(task_id="read")
    clean = EmptyOperator(task_id="clean")
    store = EmptyOperator(task_id="store")
    read >> clean >> store
with DAG("sales_sum"):
    wait = ExternalTaskSensor(task_id="wait", external_dag_id="sales_load", external_task_id="store")
    total = EmptyOperator(task_id="total")
    wait >> total
with DAG("sales_report"):
    ready = ExternalTaskSensor(task_id="ready", external_dag_id="sales_sum", external_task_id="total")
    check = EmptyOperator(task_id="check")
    report = EmptyOperator(task_id="report")
    ready >> check >> report
'''


def example(spark, output) -> dict:
    """Writes a source of three DAGs and the snapshot that is read from it."""
    src = Path(output) / "source"
    src.mkdir(parents=True, exist_ok=True)
    (src / "sales.py").write_text(EXAMPLE)
    return extract.build(spark, src, Path(output) / "graph", "urn:groundline:example")


def run(spark, a: argparse.Namespace) -> tuple:
    """(result, exit code) of parsed arguments."""
    unwell = lambda r: (r, 0 if r["status"] == "PASS" else 2)
    if a.command in ("airflow", "init"):
        return unwell(extract.build(spark, a.source, a.output, a.namespace))
    if a.command == "example":
        return unwell(example(spark, a.output))
    if a.command == "demo":
        return unwell(bootstrap.demo(spark, a.output).doctor())
    if a.command == "build":
        return unwell(compile.build(spark, a.spec, a.output, a.snapshot_id).doctor())
    if a.command == "bootstrap":
        return unwell(bootstrap.bootstrap(spark, a.root, a.output, a.spec))
    if a.command == "doctor":
        return unwell(bundle.doctor(spark, a.bundle))
    if a.command == "eval":
        r = golden.evaluate(spark, a.bundle, a.golden)
        return r, 0 if r["status"] == "PASS" else 1
    g = tools.Graph(bundle.Bundle.load(spark, a.bundle))
    if a.command == "mcp":
        serve.stdio(g) if a.transport == "stdio" else serve.http(g, a.host, a.port).serve_forever()
        return None, 0
    tool = {"find": "find_entity", "upstream": "get_upstream", "downstream": "get_downstream", "path": "find_dependency_path", "impact": "assess_change_impact"}[a.command]
    return tools.call(g, tool, {k: v for k, v in vars(a).items() if k not in ("command", "bundle")}), 0


def main(argv=None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("groundline").getOrCreate()
    try:
        r, code = run(spark, a)
    except (BundleError, ValueError, KeyError, OSError) as e:
        r, code = {"status": "ERROR", "error": str(e)}, 2
    if r is not None:
        print(json.dumps(r, ensure_ascii=False, indent=2, sort_keys=True))
    return code


if __name__ == "__main__":
    sys.exit(main())
