"""Binding question words to stored values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.outcomes import Refusal
from .scalar import fold, folded, quote

DISTINCT_CAP = 500


@dataclass(frozen=True)
class TermPack:
    """Canonical members and their other spellings."""

    name: str
    members: dict[str, tuple[str, ...]]


@dataclass(frozen=True)
class Certificate:
    status: str
    table: str = ""
    column: str = ""
    values: tuple[str, ...] = ()
    detail: str = ""


@dataclass(frozen=True)
class ValueIndex:
    """Distinct stored values of each categorical column; a column over the cap is not indexed at all and is named."""

    values: dict[tuple[str, str], tuple[str, ...]]
    unchecked: tuple[tuple[str, str], ...] = field(default=())


def index(tables: dict[str, DataFrame], cap: int = DISTINCT_CAP) -> ValueIndex:
    """Read the distinct values of every text column, all of a table's columns in one distributed pass."""
    values, unchecked = {}, []
    for table, df in tables.items():
        texts = [c for c, t in df.dtypes if t == "string" and not c.startswith("_")]
        if not texts:
            continue
        sizes = df.agg(*[F.approx_count_distinct(quote(c)).alias(str(i)) for i, c in enumerate(texts)]).first()
        for i, c in enumerate(texts):
            if sizes[str(i)] > 2 * cap:
                unchecked.append((table, c))
                continue
            found = [r[0] for r in df.select(quote(c)).where(F.col(quote(c)).isNotNull()).distinct().limit(cap + 1).collect()]
            if len(found) > cap:
                unchecked.append((table, c))
            else:
                values[table, c] = tuple(sorted(found))
    return ValueIndex(values, tuple(unchecked))


def certify(pack: TermPack, wanted: str, landed: ValueIndex) -> Certificate:
    """CERTIFIED: the member's spellings are stored in exactly one column. More columns ABSTAIN, no member or value REFUSE."""
    word = fold(wanted)
    member = next((m for m, names in pack.members.items() if word in {fold(m), *map(fold, names)}), None)
    if member is None:
        return Certificate("REFUSE", detail=f"{wanted!r} is not in {pack.name}")
    spellings = {fold(member), *map(fold, pack.members[member])}
    hits = {at: tuple(v for v in vs if fold(v) in spellings) for at, vs in landed.values.items()}
    hits = {at: vs for at, vs in hits.items() if vs}
    if not hits:
        return Certificate("ABSTAIN" if landed.unchecked else "REFUSE", detail=f"no stored value for {member!r}")
    if len(hits) > 1:
        return Certificate("ABSTAIN", detail="stored in " + ", ".join(f"{t}.{c}" for t, c in hits))
    (table, column), stored = next(iter(hits.items()))
    return Certificate("CERTIFIED", table, column, stored)


#: Words that turn a mention around.
NEGATIVE = ("not", "no", "except", "excluding", "exclude", "without", "other than", "non")


def polarity(question: str, mention: str) -> str:
    """include or exclude, by a negative word in the three words before the mention; ``unsettled`` if it occurs both ways."""
    words, target = fold(question).split(), fold(mention).split()
    found = set()
    for i in range(len(words) - len(target) + 1):
        if words[i : i + len(target)] == target:
            before = " ".join(words[max(0, i - 3) : i])
            found.add("exclude" if any(f" {n} " in f" {before} " for n in NEGATIVE) else "include")
    return "unsettled" if len(found) != 1 else found.pop()


def cascade(question: str, packs: list[TermPack], landed: ValueIndex) -> list[tuple[str, Certificate]]:
    """Bind pack after pack; the first that is mentioned and not certified, or whose polarity is unsettled, ends it."""
    out, text = [], f" {fold(question)} "
    for pack in packs:
        said = [n for m, names in pack.members.items() for n in (m, *names) if f" {fold(n)} " in text]
        for n in sorted(set(said), key=lambda n: (-len(n), n))[:1]:
            sense = polarity(question, n)
            got = certify(pack, n, landed) if sense != "unsettled" else Certificate("ABSTAIN", detail="polarity")
            out.append((sense, got))
            if got.status != "CERTIFIED":
                return out
    return out


def phrases(question: str, longest: int = 4) -> list[str]:
    words = fold(question).split()
    return sorted({" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)})


def stated_values(question: str, tables: dict[str, DataFrame], longest: int = 4) -> DataFrame:
    """Which word runs of the question are stored cells: (table, column, phrase, cell), the smallest spelling of each.

    Columns are unpivoted and semi-joined with the few phrases before anything is shuffled.
    """
    spark = next(iter(tables.values())).sparkSession
    asked = spark.createDataFrame([(p,) for p in phrases(question, longest)], "phrase string")
    parts = []
    for table, df in tables.items():
        texts = [c for c, t in df.dtypes if t == "string" and not c.startswith("_")]
        if texts:
            cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(quote(c)).alias("cell")) for c in texts])).alias("x")).select(F.lit(table).alias("table"), "x.column", "x.cell")
            parts.append(cells.where("cell is not null"))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    hits = cells.withColumn("phrase", folded(F.col("cell"))).join(F.broadcast(asked), "phrase")
    return hits.groupBy("table", "column", "phrase").agg(F.min("cell").alias("cell"))


def exact(df: DataFrame, column: str, literals: list[str], phrase: str, negative: bool = False) -> bool | Refusal:
    """A filter is exact if its literals are every stored spelling of the phrase and nothing else, and a negative one drops no null."""
    c = F.col(quote(column))
    row = df.agg(F.collect_set(F.when(folded(c) == phrase, c)).alias("spellings"), F.count(F.when(c.isNull(), 1)).alias("nulls")).first()
    if set(row.spellings) != set(literals):
        return Refusal("unhonored_qualifier", f"named_filter={phrase}")
    return Refusal("unhonored_qualifier", f"named_filter={phrase}: drops nulls") if negative and row.nulls else True
