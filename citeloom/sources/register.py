"""Ranges of ids that runs reserve before they write.

A store has one list of claims per kind of id, below ``register/<kind>``: files numbered
without gaps, each saying which ids a run took. Claim k + 1 begins where claim k ends, and a
number is taken by creating its file, which only one writer can: others see that it is there,
read it and try the next. So runs at the same time get ranges apart, no table is scanned for
its highest id, and a run that dies leaves at most ids that nobody uses.

A run that is repeated finds its claim by its name and writes the same ids again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import SparkSession

from citeloom.sources.numbered import create_text, delete, last_number, numbered, read_text


class Claim(NamedTuple):
    run: str
    after: int
    n: int


def _read(spark: SparkSession, path: str) -> Claim | None:
    text = read_text(spark, path)
    return None if text is None else Claim(**json.loads(text))


def _create(spark: SparkSession, path: str, claim: Claim) -> bool:
    return create_text(spark, path, json.dumps(claim._asdict()))


def reserve(spark: SparkSession, store: str, kind: str, run: str, n: int, base: Callable[[], int] = lambda: 0) -> int:
    """Takes ``n`` ids for ``run`` and returns the number before the first of them.

    ``base`` is asked once in a store's life, when it has no claim of this kind: the highest
    id of tables that were written without a register. A run that claimed as many ids or more
    before gets the same again.
    """
    if not n:
        return 0
    folder = f"{store}/register/{kind}"
    own = f"{folder}/runs/{run}"
    known = _read(spark, own)
    if known is not None and known.n >= n:
        return known.after
    while True:
        number = last_number(spark, folder)
        before = _read(spark, numbered(folder, number)) if number else Claim("", base(), 0)
        claim = Claim(run, before.after + before.n, n)
        if _create(spark, numbered(folder, number + 1), claim):
            if known is not None:
                delete(spark, own)
            _create(spark, own, claim)
            return claim.after


def claims(spark: SparkSession, store: str, kind: str) -> list[Claim]:
    """All claims in order: a report for one's eyes, as long as the list of runs."""
    folder = f"{store}/register/{kind}"
    return [_read(spark, numbered(folder, number)) for number in range(1, last_number(spark, folder) + 1)]
