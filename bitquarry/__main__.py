"""python -m bitquarry {merge,plan,schema,ddl} FILE [--no-prune] [--json] [--type NAME]"""

from __future__ import annotations

import argparse
import json
import sys

import yaml

from bitquarry.schema import compiler


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="bitquarry", description="Compile message schemas.")
    p.add_argument("step", choices=("merge", "plan", "schema", "ddl"))
    p.add_argument("file")
    p.add_argument("--no-prune", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--type")
    a = p.parse_args(args)
    try:
        doc = compiler.load(a.file)
        if a.step == "merge":
            out = compiler.normalise(doc, not a.no_prune)
            print(json.dumps(out, indent=2) if a.json else yaml.safe_dump(out, sort_keys=False), end="")
            return 0
        schema = compiler.compile_doc(doc, not a.no_prune)
    except (compiler.SchemaError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    if a.step == "plan":
        print(schema.explain())
        return 0
    for name, node in schema.nodes.items():
        if a.type in (None, name):
            print(f"{name}\t{node.spark_type().json() if a.step == 'schema' else node.spark_type().simpleString()}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
