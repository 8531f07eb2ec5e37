"""Stages, predictors and the command line: the extension surface."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """A named step with what it needs; run maps tables to tables."""

    name: str
    number: int
    run: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Stages:
    """Stages by name or number, in an order that respects their needs."""

    known: dict[str, Stage] = field(default_factory=dict)

    def add(self, stage: Stage) -> Stage:
        if stage.name in self.known or any(s.number == stage.number for s in self.known.values()):
            raise KeyError(f"{stage.name} or its number is registered already")
        self.known[stage.name] = stage
        return stage

    def get(self, key: str | int) -> Stage:
        for s in self.known.values():
            if key in (s.name, s.number, str(s.number)):
                return s
        raise KeyError(f"no such stage: {key}")

    def between(self, first: str | int, last: str | int) -> list[Stage]:
        lo, hi = self.get(first).number, self.get(last).number
        return [s for s in self.ordered() if lo <= s.number <= hi]

    def with_needs(self, *keys: str | int) -> list[Stage]:
        want, todo = set(), [self.get(k).name for k in keys]
        while todo:
            name = todo.pop()
            if name not in want:
                want.add(name)
                todo += self.known[name].needs
        return [s for s in self.ordered() if s.name in want]

    def ordered(self) -> list[Stage]:
        """By needs, then number; raises on a cycle."""
        out: list[Stage] = []
        state: dict[str, int] = {}

        def visit(s: Stage) -> None:
            if state.get(s.name) == 1:
                raise ValueError(f"stages need each other: {s.name}")
            if state.get(s.name) != 2:
                state[s.name] = 1
                for n in s.needs:
                    visit(self.get(n))
                state[s.name] = 2
                out.append(s)

        for s in sorted(self.known.values(), key=lambda s: s.number):
            visit(s)
        return out


def predict(rows: DataFrame, predictor: Callable[[pd.DataFrame], pd.Series], output: str = "raw_response") -> DataFrame:
    """rows with a predictor's answer and an error column: the hook for models, which stay outside. A batch that fails is answered row by row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pdf.copy()
            out["error"] = None
            try:
                out[output] = list(predictor(pdf))
            except Exception:  # noqa: BLE001  whatever a model raises becomes a row's error
                answers, errors = [], []
                for k in range(len(pdf)):
                    try:
                        answers.append(next(iter(predictor(pdf.iloc[k : k + 1]))))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        answers.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                out[output], out["error"] = answers, errors
            yield out[[*pdf.columns, output, "error"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, {output} string, error string")


def echo(pdf: pd.DataFrame) -> pd.Series:
    """The default predictor: a fixed answer."""
    return pd.Series(["===BEGIN_JSON=== {} ===END_JSON==="] * len(pdf), index=pdf.index)


def main(argv: list[str] | None = None) -> None:
    """kinegrain list | run QUERY SF_DIR [--out PATH]"""
    p = argparse.ArgumentParser(prog="kinegrain", description=main.__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    args = p.parse_args(argv)
    from .catalogue import ORACLE, QUERIES

    if args.what == "list":
        print("\n".join(f"{n}{'' if n in ORACLE else '  (no SQL)'}" for n in sorted(QUERIES)))
        return
    spark = SparkSession.builder.getOrCreate()
    df = QUERIES[args.query](spark, args.sf_dir)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        print(json.dumps([r.asDict(recursive=True) for r in df.limit(20).collect()], default=str, indent=1))


if __name__ == "__main__":
    main()
