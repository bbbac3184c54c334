"""An immutable query over one collection, compiled to a DataFrame: filters, sort, window, pages and cursors."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidOperation
from ..functions.ordering import SortSpec, order_by
from ..functions.predicates import Eq, Prefix, Range
from ..functions.values import ABSENT, is_mixed, kind_of_type, literal, present

PAGE = 50
LEFT = "_left"
last_plans: deque[dict] = deque(maxlen=1)


@dataclass(frozen=True)
class Query:
    """`df` is a snapshot of a collection, `key` its record key; every method gives a new query."""

    df: DataFrame
    key: str = "_key"
    predicates: tuple = ()
    specs: tuple[SortSpec, ...] = ()
    size: int | None = None
    skip: int = 0

    def where(self, equal: dict | None = None) -> Query:
        return replace(self, predicates=(*self.predicates, *(Eq(k, v) for k, v in (equal or {}).items())))

    def filter(self, name: str, value: object) -> Query:
        return replace(self, predicates=(*self.predicates, Eq(name, value)))

    def range(self, name: str, min: object = None, max: object = None) -> Query:  # noqa: A002
        return replace(self, predicates=(*self.predicates, Range(name, min, max)))

    def prefix(self, name: str, prefix: str) -> Query:
        return replace(self, predicates=(*self.predicates, Prefix(name, prefix)))

    def sort(self, specs: list[SortSpec]) -> Query:
        return replace(self, specs=tuple(specs))

    def limit(self, n: int) -> Query:
        if n < 0:
            raise InvalidOperation("a limit can't be negative")
        return replace(self, size=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise InvalidOperation("an offset can't be negative")
        return replace(self, skip=n)

    def condition(self) -> Column:
        return reduce(and_, (p.column(self.df) for p in self.predicates), F.lit(True))

    def matching(self) -> DataFrame:
        """The rows that match, in no order and without the window."""
        return self.df.where(self.condition()) if self.predicates else self.df

    def ordered(self) -> DataFrame:
        return self.matching().orderBy(*order_by(self.df, self.specs, self.key))

    def find_all(self) -> DataFrame:
        """The rows in order: by the sort, or by record key.  A limit makes it a top-k without a full sort."""
        out = self.ordered()
        if self.skip:
            out = out.offset(self.skip)
        return out if self.size is None else out.limit(self.size)

    def first(self) -> Row | None:
        with self._kept_plan():
            return replace(self, size=1).find_all().first()

    def count(self) -> int:
        """How many rows match; sort and window don't matter."""
        with self._kept_plan():
            return self.matching().count()

    def distinct(self, name: str) -> DataFrame:
        """The different values of a field in matching rows, an explicit null among them; the window doesn't matter."""
        return self.matching().where(present(self.df, name)).select(name).distinct()

    def iterate(self) -> Iterator[Row]:
        return self.find_all().toLocalIterator()

    def after(self, row: Row | dict) -> Column:
        """Rows that come after `row` in this query's order: a keyset condition on the whole sort tuple."""
        row = row.asDict() if isinstance(row, Row) else row  # structs in it stay rows
        steps: list[tuple[Column, Column]] = []  # (equal, after) for each part of the order
        for s in self.specs:
            if s.field not in self.df.columns:
                continue
            c, v = F.col(s.field), row[s.field]
            if ABSENT in self.df.columns:
                missing = s.field in (row[ABSENT] or ())
                here = present(self.df, s.field)
                steps.append((here != F.lit(missing), F.lit(False) if missing != s.descending else (here if s.descending else ~here)))
            kind = self.df.schema[s.field].dataType
            value = literal(v, kind) if is_mixed(kind) else F.lit(v).cast(kind)
            if v is None:
                steps.append((c.isNull(), F.lit(False) if s.descending else c.isNotNull()))
            else:
                steps.append((c.eqNullSafe(value), F.coalesce(c < value, F.lit(True)) if s.descending else F.coalesce(c > value, F.lit(False))))
        k, t = F.col(self.key), self.df.schema[self.key].dataType
        v = F.lit(row[self.key]).cast(t)
        kind = kind_of_type(t)
        parts = {"string": [F.octet_length], "bytes": [F.octet_length], "int": [lambda x: x < 0], "bigint": [lambda x: x < 0], "double": [lambda x: x < 0]}.get(kind, [])
        steps += [(f(k) == f(v), f(k) > f(v)) for f in parts]
        steps.append((k == v, (F.abs(k) > F.abs(v)) if kind == "double" else k > v))
        ways = [reduce(and_, [e for e, _ in steps[:i]], F.lit(True)) & a for i, (_, a) in enumerate(steps)]
        return reduce(or_, ways)

    def find_page(self, after: Row | dict | None = None, page_size: int | None = None) -> tuple[list[Row], Row | None]:
        """The next page and the row to go on after, null at the end; a page has one row at least.

        A limit holds for all pages together: the row to go on after carries in LEFT how many rows may follow.
        """
        n = max(1, page_size if page_size is not None else self.size or PAGE)
        at = after.asDict() if isinstance(after, Row) else after
        left = self.size if at is None else at.get(LEFT, self.size)
        if left is not None and left <= 0:
            return [], None
        query = self if at is None else replace(self, df=self.df.where(self.after(at)), skip=0)
        most = n if left is None else min(n, left)
        with self._kept_plan():
            rows = replace(query, size=most + 1).find_all().collect()
        if len(rows) <= most or (left is not None and left <= most):
            return rows[:most], None
        last = rows[most - 1]
        return rows[:most], last if left is None else Row(*last.__fields__, LEFT)(*last, left - most)

    @contextmanager
    def _kept_plan(self) -> Iterator[None]:
        """Keep how long a terminal operation took, for `last_plan`."""
        start = time.perf_counter()
        yield
        last_plans.append({"predicates": [type(p).__name__ for p in self.predicates], "sort": [s.field for s in self.specs], "limit": self.size, "offset": self.skip, "seconds": time.perf_counter() - start, "plan": self.explain})

    @staticmethod
    def last_plan() -> dict | None:
        """The filters, sort, window and time of the last query that was run, and a function that gives its plan."""
        return last_plans[-1] if last_plans else None

    def cursor(self, page_size: int | None = None) -> Cursor:
        return Cursor(self, max(1, page_size if page_size is not None else self.size or PAGE))

    def explain(self) -> str:
        return self.find_all()._jdf.queryExecution().toString()


@dataclass
class Cursor:
    """Pages of one frozen snapshot: disjoint, and all rows together."""

    query: Query
    size: int
    left: int | None = field(init=False)
    at: Row | None = None
    done: bool = False
    disposed: bool = False

    def __post_init__(self) -> None:
        self.left = self.query.size

    def next(self) -> tuple[list[Row], Row | None]:
        if self.disposed:
            raise InvalidOperation("the cursor is disposed")
        if self.done or self.left == 0:
            return [], None
        n = self.size if self.left is None else min(self.size, self.left)
        rows, self.at = replace(self.query, size=None).find_page(self.at, n)
        if self.left is not None:
            self.left -= len(rows)
        self.done = self.at is None or self.left == 0
        return rows, None if self.done else self.at

    def dispose(self) -> None:
        self.disposed = True
