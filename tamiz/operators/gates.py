"""Gates that commit: a workspace of tables in versions, moved on by one decision at a time (STM-01, STM-02, SNK-04, SNK-14).

A version is one small file that names the folders of each table; folders are written once and never changed. A commit writes what it
changes, then the next version's file under a name of its own, and renames that to the next version. If the version is there already, some
other decision came first, and this one is refused: what it was decided on is not what is current any more.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.operators import audit, governance

#: The tables that a lock names, and the fields of a trace.
LOCKED = ("screening_decisions", "evidence_verifications")
TRACE = ("stage", "item", "event", "artifact", "result")


class Stale(ValueError):
    """Another decision was committed since this workspace was read."""


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def digest(table: DataFrame) -> str:
    """A hash of a table's rows in any order, a sum of parts: equal tables have equal digests however they are stored."""
    columns = sorted(table.columns)
    row = F.xxhash64(*[F.col(c).cast("string") for c in columns], *[F.col(c).isNull() for c in columns])
    got = table.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return f"{got['n']:x}-{int(got['s'] or 0) % (1 << 64):016x}-{(got['x'] or 0) % (1 << 64):016x}"


@dataclasses.dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    root: str
    version: int
    folders: dict[str, list[str]]
    lock: dict[str, str]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in self.folders[name]])

    def commit(self, replaced: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> Workspace:
        """The next version: tables ``replaced`` whole, and rows ``added`` to others. ``Stale`` if another commit came first; then nothing is changed."""
        folders, lock = dict(self.folders), dict(self.lock)
        for name, table in replaced.items():
            folders[name] = [_put(self.root, name, table)]
        for name, table in (added or {}).items():
            folders[name] = [*folders.get(name, []), _put(self.root, name, table)]
        new = Workspace(self.spark, self.root, self.version + 1, folders, lock)
        lock |= {name: digest(new.read(name)) for name in LOCKED if name in replaced or name in (added or {})}
        jvm, at, fs = _files(self.spark, self.root)
        path = lambda name: jvm.org.apache.hadoop.fs.Path(at, name)
        draft = path(f"_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps({"folders": folders, "lock": lock}).encode())
        out.close()
        if fs.exists(path(_name(new.version))) or not _moved(jvm, fs, draft, path(_name(new.version))):
            fs.delete(draft, False)
            raise Stale(f"version {new.version} is there already")
        return new


def _moved(jvm, fs, draft, to) -> bool:
    """Rename that never replaces: an existing target is an error to the file context, and makes this one the loser."""
    none = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    options = jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
    jvm.java.lang.reflect.Array.set(options, 0, none)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(draft, to, options)
    except Exception as e:  # noqa: BLE001  (py4j wraps it)
        if "AlreadyExists" in str(e) or "exist" in str(e):
            return False
        raise
    return True


def _name(version: int) -> str:
    return f"version-{version:09d}.json"


def _put(root: str, name: str, table: DataFrame) -> str:
    folder = f"{name}-{uuid.uuid4().hex}"
    table.write.parquet(f"{root}/{folder}")
    return folder


def created(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> Workspace:
    """A workspace's first version."""
    _, at, fs = _files(spark, root)
    fs.mkdirs(at)
    return Workspace(spark, root, 0, {}, {}).commit(tables)


def opened(spark: SparkSession, root: str) -> Workspace:
    """The current version."""
    jvm, at, fs = _files(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("version-"))
    if not names:
        raise ValueError(f"no workspace in {root}")
    found = json.loads(spark.read.text(f"{root}/{names[-1]}", wholetext=True).first().value)
    return Workspace(spark, root, int(names[-1][8:17]), found["folders"], found["lock"])


def _traced(decided: DataFrame, stage: str, item: str, event: str, artifact: str, result: str) -> DataFrame:
    values = (F.lit(stage), F.col(item).cast("string"), F.lit(event), F.lit(artifact), F.col(result))
    return decided.select(*[v.alias(c) for v, c in zip(values, TRACE, strict=True)])


def screen(space: Workspace, decisions: DataFrame) -> Workspace:
    """Decisions (record_id, human_decision, human_reason, reviewer) on pending records leave the queue, replace earlier ones of their records, and are traced; see ``governance.decide``."""
    pending, made = governance.decide(space.read("screening_pending"), space.read("screening_decisions"), decisions, "record_id", "human_reason")
    trace = _traced(decisions, "screening", "record_id", "human_decision", "screening_decisions", "human_decision")
    return space.commit({"screening_pending": pending, "screening_decisions": made}, {"trace": trace})


def verify(space: Workspace, verdicts: DataFrame) -> Workspace:
    """Verdicts (evidence_id, verdict, human_correction, reviewer) on pending evidence. Verified ones enter the ledger, with a correction in place of what was said; they need a record that was screened as include. Rejected ones leave it. All leave the queue."""
    pending = space.read("evidence_pending")
    met = verdicts.join(pending, "evidence_id").join(space.read("screening_decisions").select(F.col("record_id").alias("source_id"), "human_decision"), "source_id", "left")
    bad = verdicts.join(pending, "evidence_id", "left_anti").select("evidence_id").unionByName(met.where("verdict = 'verified' and not coalesce(human_decision = 'include', false)").select("evidence_id"))
    if not bad.isEmpty():
        raise ValueError("a verdict needs pending evidence, a verified one a record that was screened as include")
    said = F.coalesce(F.nullif(F.trim("human_correction"), F.lit("")), F.col("ai_interpretation")).alias("final_interpretation")
    entered = met.where("verdict = 'verified'").select(*[c for c in pending.columns if c != "ai_interpretation"], said, "reviewer")
    ledger = space.read("evidence_ledger").join(verdicts, "evidence_id", "left_anti").unionByName(entered)
    kept = audit.upsert(space.read("evidence_verifications"), verdicts.join(pending.select("evidence_id", "source_id"), "evidence_id").select(*space.read("evidence_verifications").columns), ["evidence_id"])
    trace = _traced(verdicts, "evidence", "evidence_id", "human_verification", "evidence_ledger", "verdict")
    return space.commit({"evidence_pending": pending.join(verdicts, "evidence_id", "left_anti"), "evidence_verifications": kept, "evidence_ledger": ledger}, {"trace": trace})


def lock_problems(space: Workspace) -> list[str]:
    """Tables whose rows are not those that the lock names."""
    return sorted(name for name, held in space.lock.items() if digest(space.read(name)) != held)
