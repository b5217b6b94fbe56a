"""The check algebra: three-valued verdicts over rows, with null counted as failure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.shapes import top_shapes

FLOOR = 30


class Verdict(str, Enum):
    PASS = "PASS"
    INCONCLUSIVE = "INCONCLUSIVE"
    FAIL = "FAIL"


@dataclass(frozen=True)
class Evidence:
    name: str
    verdict: Verdict
    measured: dict[str, Any] = field(default_factory=dict)
    basis: str = "measured"

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, "verdict": self.verdict.value, "measured": self.measured, "basis": self.basis}

    def __str__(self) -> str:
        return f"{self.verdict.value} {self.name} " + " ".join(f"{k}={v}" for k, v in self.measured.items())


def worst(evidence: list[Evidence]) -> Verdict:
    """FAIL over INCONCLUSIVE over PASS; nothing at all is INCONCLUSIVE."""
    verdicts = [e.verdict for e in evidence]
    return next((v for v in (Verdict.FAIL, Verdict.INCONCLUSIVE) if v in verdicts), Verdict.PASS if verdicts else Verdict.INCONCLUSIVE)


@dataclass(frozen=True)
class Check:
    """A row predicate, true where the row is valid, and the columns that it reads."""

    name: str
    build: Callable[[], Column]
    columns: tuple[str, ...] = ()
    origin: str = ""
    description: str = ""

    def expr(self) -> Column:
        return self.build()

    def evaluate(self, df: DataFrame) -> Evidence:
        bad = text.fails(self.expr())
        row = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
        if not row["n"]:
            return Evidence(self.name, Verdict.INCONCLUSIVE, {"rows": 0})
        measured: dict[str, Any] = {"rows": row["n"], "failing": row["bad"]}
        if row["bad"]:
            failing = df.where(bad)
            measured |= {f"shapes {c}": top_shapes(failing, c) for c in self.columns}
        return Evidence(self.name, Verdict.FAIL if row["bad"] else Verdict.PASS, measured)

    def failing(self, df: DataFrame) -> DataFrame:
        return df.where(text.fails(self.expr()))


REGISTRY: dict[str, Check] = {}
#: Names of checks that a test has shown to catch a mutation.
FIRED: set[str] = set()


def check(*columns: str, name: str | None = None, origin: str = "") -> Callable[[Callable[[], Column]], Check]:
    """Register a row check. The same name from another module is an error."""

    def register(build: Callable[[], Column]) -> Check:
        own = name or build.__name__
        source = origin or build.__module__
        if own in REGISTRY and REGISTRY[own].origin != source:
            raise ValueError(f"check {own!r} is already registered by {REGISTRY[own].origin}")
        doc = (build.__doc__ or "").strip().split("\n")[0]
        REGISTRY[own] = Check(own, build, columns, source, doc)
        return REGISTRY[own]

    return register


# Dirt: what a cleaner would change.
Cleaner = Callable[[Column], Column]


def dirty_expr(column: str, clean: Cleaner) -> Column:
    return text.differs(clean(F.col(column)), F.col(column))


def measure_dirt(df: DataFrame, column: str, clean: Cleaner) -> Evidence:
    dirty = dirty_expr(column, clean)
    row = df.agg(F.count("*").alias("n"), F.count_if(dirty).alias("dirty")).first()
    name = f"dirt {column}"
    if not row["n"]:
        return Evidence(name, Verdict.INCONCLUSIVE, {"rows": 0})
    found = df.where(dirty).select(F.col(column).alias("before"), clean(F.col(column)).alias("after"))
    shapes = {"shapes before": top_shapes(found, "before"), "shapes after": top_shapes(found, "after")} if row["dirty"] else {}
    return Evidence(name, Verdict.PASS, {"rows": row["n"], "dirty": row["dirty"], "rate": round(row["dirty"] / row["n"], 6), **shapes})


# Witnesses: derived == derive(witness).
def verify_derivation(df: DataFrame, *, derived: str, witness: str, derive: Cleaner) -> Evidence:
    row = df.agg(F.count("*").alias("n"), F.count_if(text.differs(F.col(derived), derive(F.col(witness)))).alias("bad")).first()
    verdict = Verdict.INCONCLUSIVE if not row["n"] else Verdict.FAIL if row["bad"] else Verdict.PASS
    return Evidence(f"{derived} from {witness}", verdict, {"rows": row["n"], "mismatches": row["bad"]})


def verify_repair(pre: DataFrame, post: DataFrame, *, repaired: str, witness: str, derive: Cleaner) -> Evidence:
    """Equal counts and columns, equal untouched columns as multisets, and the derivation holds.

    Frames have no order here, so a mere permutation of rows passes.
    """
    name = f"repair {repaired}"
    if pre.columns != post.columns:
        return Evidence(name, Verdict.FAIL, {"columns": False})
    n, m = pre.count(), post.count()
    if n != m:
        return Evidence(name, Verdict.FAIL, {"rows before": n, "rows after": m})
    if not n:
        return Evidence(name, Verdict.INCONCLUSIVE, {"rows": 0})
    rest = [c for c in pre.columns if c != repaired]
    touched = multiset_difference(pre.select(rest), post.select(rest)).count()
    derivation = verify_derivation(post, derived=repaired, witness=witness, derive=derive)
    changed = multiset_difference(post, pre).count()
    ok = not touched and derivation.verdict is Verdict.PASS
    return Evidence(name, Verdict.PASS if ok else Verdict.FAIL, {"rows": n, "changed": changed, "other columns": touched, "mismatches": derivation.measured["mismatches"]})


# Rates and profile gates.
@dataclass(frozen=True)
class Rate:
    num: float = 0
    den: float = 0

    @property
    def value(self) -> float | None:
        return self.num / self.den if self.den else None

    def __add__(self, other: Rate) -> Rate:
        return Rate(self.num + other.num, self.den + other.den)

    @staticmethod
    def of(df: DataFrame, num: Column, den: Column) -> Rate:
        row = df.agg(F.sum(num).alias("num"), F.sum(den).alias("den")).first()
        return Rate(row["num"] or 0, row["den"] or 0)


Gate = Callable[[DataFrame], Evidence]


def rows_at_least(n: int) -> Gate:
    def gate(df: DataFrame) -> Evidence:
        rows = df.count()
        return Evidence(f"rows >= {n}", Verdict.PASS if rows >= n else Verdict.FAIL, {"rows": rows})

    return gate


def _share_gate(name: str, share: Column, ok: Callable[[float], bool], key: str, min_rows: int) -> Gate:
    def gate(df: DataFrame) -> Evidence:
        row = df.agg(F.count("*").alias("n"), share.alias("x")).first()
        if row["n"] < min_rows:
            return Evidence(name, Verdict.INCONCLUSIVE, {"rows": row["n"], "floor": min_rows})
        return Evidence(name, Verdict.PASS if ok(row["x"]) else Verdict.FAIL, {"rows": row["n"], key: round(row["x"], 6)})

    return gate


def null_rate_at_most(column: str, most: float, *, min_rows: int = FLOOR) -> Gate:
    return _share_gate(f"nulls of {column} <= {most}", F.avg(F.col(column).isNull().cast("double")), lambda x: x <= most, "null_rate", min_rows)


def share_at_least(label: str, e: Column, least: float, *, min_rows: int = FLOOR) -> Gate:
    return _share_gate(f"{label} >= {least}", F.avg(text.holds(e).cast("double")), lambda x: x >= least, "share", min_rows)


# Multisets.
def as_texts(df: DataFrame) -> DataFrame:
    return df.select(*[text.as_text(F.col(f"`{c}`")).alias(c) for c in df.columns])


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return as_texts(a).exceptAll(as_texts(b).toDF(*a.columns))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets, nulls equal."""
    return len(a.columns) == len(b.columns) and not multiset_difference(a, b).limit(1).count() and not multiset_difference(b, a).limit(1).count()
