"""Split revisions of a snapshot: prepared in one pass, checked, frozen as files, and read page by page.

A revision is a folder splits/<snapshot>/<revision> with members/ (a row per split and sample, sorted by both) and, written
last, record.json. A rule is a boolean Column over the samples, or `Inherited`: the members of a split of the parent
snapshot. The selected revision of a snapshot is a compare-and-set on a generation, as a dataset's head.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.catalog import Conflict, Files
from skein.operators.dataset import MAX_SPLITS, Rejected, satisfied, split_report


@dataclass(frozen=True)
class Inherited:
    snapshot: str
    revision: int
    name: str


class Splits:
    def __init__(self, files: Files):
        self.files, self.spark = files, files.spark

    def _at(self, snapshot: str, revision: int) -> str:
        return f"splits/{snapshot}/{revision:08}"

    def revisions(self, snapshot: str) -> list[int]:
        """Finished revisions, oldest first."""
        return [int(n) for n in self.files.names(f"splits/{snapshot}") if n.isdigit() and self.files.exists(f"splits/{snapshot}/{n}/record.json")]

    def record(self, snapshot: str, revision: int) -> dict:
        return json.loads(self.files.read(f"{self._at(snapshot, revision)}/record.json"))

    def prepare(self, snapshot: str, samples: DataFrame, rules: dict[str, Column | Inherited], *, parent: str | None = None, overlap_allowed: bool = False, unassigned_allowed: bool = True) -> dict:
        """Writes the next revision from samples(sample_id, ...); raises, and leaves none, if the policy is not met."""
        if not 0 < len(rules) <= MAX_SPLITS:
            raise Rejected(f"a revision has 1 to {MAX_SPLITS} splits")
        taken = [int(n) for n in self.files.names(f"splits/{snapshot}") if n.isdigit()]
        revision = max(taken, default=0) + 1
        at = f"{self.files.root}/{self._at(snapshot, revision)}/members"
        hits, rows = [], samples
        for k, (name, rule) in enumerate(sorted(rules.items())):
            if isinstance(rule, Inherited):
                if rule.snapshot != parent:
                    raise Rejected("a split is inherited from the parent snapshot only")
                if rule.name not in self.record(rule.snapshot, rule.revision)["splits"]:
                    raise Rejected(f"no split {rule.name}")
                frozen = self.members(rule.snapshot, rule.revision, rule.name).withColumn(f"_in{k}", F.lit(True))
                rows = rows.join(frozen, "sample_id", "left")
                rule = F.col(f"_in{k}")
            hits.append(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)))
        found = rows.select("sample_id", F.explode(F.array_compact(F.array(*hits))).alias("split"))
        found.repartitionByRange("split", "sample_id").sortWithinPartitions("split", "sample_id").write.partitionBy("split").parquet(at)
        members = self._read(at)
        report = split_report(samples, members)
        row = report.withColumn("ok", satisfied(report, overlap_allowed=overlap_allowed, unassigned_allowed=unassigned_allowed)).first()
        if not row["ok"]:
            self.files.remove(self._at(snapshot, revision))
            raise Rejected(f"the policy is not met: {row['overlapping']} in several splits, {row['unassigned']} in none")
        counts = {r["split"]: r["count"] for r in members.groupBy("split").count().collect()}
        record = {"snapshot": snapshot, "revision": revision, "parent": parent, "splits": {n: counts.get(n, 0) for n in rules}, "scanned": row["scanned"], "unassigned": row["unassigned"], "overlapping": row["overlapping"]}
        self.files.create(f"{self._at(snapshot, revision)}/record.json", json.dumps(record))
        return record

    def _read(self, at: str) -> DataFrame:
        return self.spark.read.schema("sample_id binary, split string").parquet(at)

    def members(self, snapshot: str, revision: int, name: str, after: bytes | None = None, limit: int | None = None) -> DataFrame:
        """The sample ids of a split; with a limit, the page of them after an id."""
        if name not in self.record(snapshot, revision)["splits"]:
            raise Rejected(f"no split {name}")
        rows = self._read(f"{self.files.root}/{self._at(snapshot, revision)}/members").filter(F.col("split") == name).select("sample_id")
        rows = rows if after is None else rows.filter(F.col("sample_id") > F.lit(after))
        return rows if limit is None else rows.orderBy("sample_id").limit(limit)

    def head(self, snapshot: str) -> dict:
        names = [n for n in self.files.names(f"splits/{snapshot}/head") if n.endswith(".json")]
        return json.loads(self.files.read(f"splits/{snapshot}/head/{max(names)}")) if names else {"revision": None, "generation": 0}

    def select(self, snapshot: str, revision: int, generation: int) -> dict:
        """Makes a revision the selected one if the head is still of that generation."""
        now = self.head(snapshot)
        self.record(snapshot, revision)
        if now["revision"] == revision:
            return now
        if now["generation"] != generation:
            raise Conflict(f"generation {now['generation']}, not {generation}")
        new = {"revision": revision, "generation": generation + 1}
        self.files.create(f"splits/{snapshot}/head/{new['generation']:012}.json", json.dumps(new))
        return new
