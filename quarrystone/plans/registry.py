"""Verified queries by question, derived ontologies of a space, name scrubbing and statement budgets."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.retrieval import TOP, bm25
from ..functions.scalar import fold
from .governance import fold_ascii, gate, query, schema_fingerprint
from .ontology import Ontology
from .outcomes import Refusal, Violation

COMPANY = "company-default"


@dataclass(frozen=True)
class Verified:
    question: str
    sql: str
    space: str = COMPANY


@dataclass
class Registry:
    """Questions with the statement that answers them, seen by their space; the company's own are seen by all."""

    spark: SparkSession
    entries: dict[tuple[str, str], Verified] = field(default_factory=dict)
    scored: set[str] = field(default_factory=set)

    def register(self, v: Verified, granted: Iterable[str]) -> Verified | Refusal:
        """Keep a statement that passes the gate and is not one that answers are scored with."""
        passed = gate(self.spark, v.sql, granted)
        if isinstance(passed, Refusal):
            return passed
        if content_hash(v.question, v.sql) in self.scored:
            return Refusal("scored_row", v.question)
        self.entries[v.space, fold(v.question)] = v
        return v

    def find(self, question: str, space: str) -> Verified | None:
        """The entry with the same question, case, accents and punctuation aside; the space's own first."""
        return self.entries.get((space, fold(question))) or self.entries.get((COMPANY, fold(question)))

    def ask(self, question: str, space: str, granted: Iterable[str]) -> DataFrame | Refusal:
        found = self.find(question, space)
        return query(self.spark, found.sql, granted) if found else Refusal("no_verified_query", question)

    def examples(self, question: str, space: str, top: int = TOP) -> list[Verified]:
        """The entries most like a question by BM25, score above 0; equal scores by question."""
        seen = [v for v in self.entries.values() if v.space in (space, COMPANY)]
        if not seen:
            return []
        docs = self.spark.createDataFrame([(i, v.question) for i, v in enumerate(seen)], "i long, question string")
        asked = self.spark.createDataFrame([(0, question)], "q long, asked string")
        ranked = bm25(docs, asked, "i", "question", "q", "asked").join(docs, "i").orderBy(F.desc("score"), "question").limit(top).collect()
        return [seen[r.i] for r in ranked]


def content_hash(question: str, sql: str) -> str:
    return hashlib.sha256(f"{fold(question)}\n{' '.join(sql.split()).lower()}".encode()).hexdigest()


def without_scored(rows: DataFrame, scored: DataFrame, question: str = "question", sql: str = "sql") -> DataFrame:
    """Rows whose content is not among the scored ones."""
    def key(df: DataFrame) -> DataFrame:
        norm = F.lower(F.trim(F.regexp_replace(F.concat_ws("\n", question, sql), r"\s+", " ")))
        return df.withColumn("__h", F.sha2(norm, 256))

    return key(rows).join(key(scored).select("__h").distinct(), "__h", "left_anti").drop("__h")


def derive(spark: SparkSession, manifest: dict, frame_of: Callable[[dict], DataFrame], stored: dict | None = None) -> tuple[Ontology, list[Violation], dict]:
    """The ontology that declared keys give, measured, and the item to store: reused if no schema changed, active if all
    claims hold, else proposed."""
    o = Ontology.from_manifest(spark, manifest, frame_of)
    violations = o.verify()
    prints = {n: schema_fingerprint(x.relation()) for n, x in sorted(o.objects.items())}
    status = "reused" if stored and stored.get("schemas") == prints else "active" if not violations else "proposed"
    return o, violations, {"schemas": prints, "status": status, "links": {x.name: [x.cardinality, x.max_fanout] for x in o.links.values()}}


def scrub(text: str, known: Iterable[str], granted: Iterable[str]) -> str:
    """An error text without the names of things that are not granted."""
    allowed = {fold_ascii(g) for g in granted}
    hidden = sorted({k for k in known if fold_ascii(k) not in allowed}, key=len, reverse=True)
    return re.sub("|".join(rf"(?<!\w){re.escape(k)}(?!\w)" for k in hidden), "[hidden]", text, flags=re.I) if hidden else text


def within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object | Refusal:
    """Run Spark work in a job group that is cancelled when its time is up."""
    group, late = f"budget-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "statement budget", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return work()
    except Exception:
        if late.is_set():
            return Refusal("deadline", f"{seconds} s")
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def mint(session: dict, key: bytes) -> str:
    """A signed session manifest."""
    body = json.dumps(session, sort_keys=True)
    return f"{hmac.new(key, body.encode(), hashlib.sha256).hexdigest()}.{body}"


def opened(token: str, key: bytes) -> dict | Refusal:
    sign, _, body = token.partition(".")
    good = hmac.compare_digest(sign, hmac.new(key, body.encode(), hashlib.sha256).hexdigest())
    return json.loads(body) if good else Refusal("bad_signature", "")
