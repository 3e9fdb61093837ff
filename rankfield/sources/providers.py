"""Other sources of files: one that cannot be asked is not one that found nothing.  Deadlines and cancellation by job tags."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rankfield.functions.text import fold_text

#: Fixed value: how long providers of the root list are waited for, in seconds.
DEADLINE = 0.15


class Unavailable(Exception):
    """There is nothing to ask."""


class Failed(Exception):
    """It was asked, and failed."""


class Provider(Protocol):
    def search(self, q: str, most: int) -> DataFrame:
        """Rows of at least name, best first, at most so many; raises Unavailable or Failed."""


@dataclass
class Answer:
    """status: ok, unavailable, failed or late; only ok has rows, and those may be none."""

    status: str
    rows: list[Row]
    message: str = ""


@dataclass
class LikeProvider:
    """Entries (name) whose folded name holds every word of the query, shorter names first."""

    entries: DataFrame | None

    def search(self, q: str, most: int) -> DataFrame:
        if self.entries is None:
            raise Unavailable("no entries")
        out = self.entries
        for word in fold_text(q).split():
            out = out.where(F.contains(F.lower("name"), F.lit(word)))
        return out.orderBy(F.length("name"), "name").limit(most)


def answer(provider: Provider, q: str, most: int) -> Answer:
    try:
        return Answer("ok", provider.search(q, most).collect())  # at most a page
    except Unavailable as e:
        return Answer("unavailable", [], str(e))
    except Exception as e:  # a provider's failure is its answer, whatever it is
        return Answer("failed", [], str(e))


class Cancelled(Exception):
    """The work was stopped; nothing of it is returned."""


class Work:
    """Spark work that another thread can stop."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.stopped = spark, f"work-{uuid.uuid4().hex}", False

    def run(self, f: Callable[[], object]) -> object:
        """f's result, or Cancelled: never a part of it."""
        if self.stopped:
            raise Cancelled
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            out = f()
        except Exception:
            if self.stopped:
                raise Cancelled from None
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        if self.stopped:
            raise Cancelled
        return out

    def stop(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def ask_all(spark: SparkSession, providers: dict[str, Provider], q: str, most: dict[str, int], deadline: float = DEADLINE) -> dict[str, Answer]:
    """Every provider's answer to one query, side by side, each with its own cap; one that is not done by the deadline is late, and stopped."""
    works = {name: Work(spark) for name in providers}
    with ThreadPoolExecutor(max(1, len(providers))) as pool:
        asked = {name: pool.submit(works[name].run, lambda p=p, n=name: answer(p, q, most[n])) for name, p in providers.items()}
        done, late = wait(asked.values(), deadline)
        out = {}
        for name, f in asked.items():
            if f in late:
                works[name].stop()
                out[name] = Answer("late", [])
            else:
                out[name] = f.result()
    return out
