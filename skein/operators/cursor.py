"""Read cursors and dataset heads: stateless tokens bound to a plan, and compare-and-set on a generation."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.catalog import Conflict, Files


class Refused(ValueError):
    """A token that does not belong to the plan, or no token at all."""


def plan_identity(plan: dict) -> str:
    return hashlib.md5(json.dumps(plan, sort_keys=True, default=str).encode()).hexdigest()


_MARK = 16


def _mark(raw: bytes, secret: bytes) -> bytes:
    return hmac.new(secret, raw, hashlib.sha256).digest()[:_MARK]


@dataclass(frozen=True)
class Cursor:
    """Where a read is: after a sample id, at an ordinal, and at an offset in the group that begins there."""

    plan: str
    snapshot: str
    after: str = ""
    ordinal: int = 0
    offset: int = 0
    version: int = 2

    def token(self, secret: bytes | None = None) -> str:
        """The cursor as text; with a secret, signed, so that only who has the secret can make one."""
        raw = json.dumps(asdict(self), separators=(",", ":")).encode()
        return base64.urlsafe_b64encode(raw + (_mark(raw, secret) if secret else b"")).rstrip(b"=").decode()

    @classmethod
    def parse(cls, token: str, plan: dict, secret: bytes | None = None) -> Cursor:
        try:
            raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
            if secret:
                raw, mark = raw[:-_MARK], raw[-_MARK:]
                if not hmac.compare_digest(mark, _mark(raw, secret)):
                    raise Refused("the cursor's signature is wrong")
            out = cls(**json.loads(raw))
        except (ValueError, TypeError) as e:
            raise e if isinstance(e, Refused) else Refused("no cursor") from e
        if out.version != 2 or out.plan != plan_identity(plan) or out.ordinal < 0 or out.offset < 0:
            raise Refused("the cursor is of another plan")
        return out

    def moved(self, rows: int, group: int, last: str) -> Cursor:
        """After `rows` more of a group of this size; a finished group moves the id and the ordinal on."""
        done = self.offset + rows
        return replace(self, offset=done) if done < group else replace(self, after=last, ordinal=self.ordinal + group, offset=0)


class Head:
    """A dataset's {latest, stable, generation} in a folder: each generation is a file that is created once."""

    def __init__(self, files: Files):
        self.files = files

    def read(self) -> dict:
        names = [n for n in self.files.names("head") if n.endswith(".json")]
        if not names:
            return {"latest": None, "stable": None, "generation": 0}
        return json.loads(self.files.read(f"head/{max(names)}"))

    def select(self, generation: int, *, latest: str | None = None, stable: str | None = None) -> dict:
        """Moves the head if it is still of that generation; selecting what is selected changes nothing."""
        now = self.read()
        new = {"latest": latest or now["latest"], "stable": stable or now["stable"], "generation": now["generation"] + 1}
        if (new["latest"], new["stable"]) == (now["latest"], now["stable"]):
            return now
        if now["generation"] != generation:
            raise Conflict(f"generation {now['generation']}, not {generation}")
        self.files.create(f"head/{new['generation']:012}.json", json.dumps(new))
        return new


@dataclass(frozen=True)
class ReadCursor:
    """A cursor of version 1: a group and an offset in it; it moves only when a batch is confirmed."""

    plan: str
    snapshot: str
    group: int = 0
    offset: int = 0

    @classmethod
    def start(cls, plan: dict, snapshot: str) -> ReadCursor:
        return cls(plan_identity(plan), snapshot)

    def check(self, plan: dict, snapshot: str) -> None:
        if (self.plan, self.snapshot) != (plan_identity(plan), snapshot):
            raise Refused("the cursor is of another plan or snapshot")

    def confirmed(self, plan: dict, snapshot: str, group: int, offset: int) -> ReadCursor:
        self.check(plan, snapshot)
        return replace(self, group=group, offset=offset)

    def rest(self, numbered_samples: DataFrame, group_size: int) -> DataFrame:
        """The samples (with `ordinal`) from the cursor on."""
        return numbered_samples.filter(F.col("ordinal") >= self.group * group_size + self.offset)


@dataclass(frozen=True)
class Binding:
    """What a read is bound to: the snapshot that an alias named then, a pinned split revision, and the first cursor."""

    snapshot: str
    revision: int | None
    plan: dict
    token: str


def bind(head: Head, splits, plan: dict) -> Binding:
    """Resolves plan['snapshot'] (an id, latest or stable) and pins plan['split'] = {name, revision?} to a revision."""
    now = head.read()
    snapshot = {"latest": now["latest"], "stable": now["stable"]}.get(plan["snapshot"], plan["snapshot"])
    if snapshot is None:
        raise Refused("the alias names no snapshot")
    plan = plan | {"snapshot": snapshot}
    revision = None
    if split := plan.get("split"):
        revision = split.get("revision") or splits.head(snapshot)["revision"]
        if revision is None or split["name"] not in splits.record(snapshot, revision)["splits"]:
            raise Refused(f"no split {split['name']}")
        plan = plan | {"split": split | {"revision": revision}}
    return Binding(snapshot, revision, plan, Cursor(plan_identity(plan), snapshot).token())


class Delivery:
    """Batches of an ordered read, one in flight: a batch that is not acknowledged comes again, also to a new Delivery that
    goes on from the token. Samples have `sample_id` and `ordinal`."""

    def __init__(self, numbered_samples: DataFrame, plan: dict, token: str, batch: int):
        self.samples, self.plan, self.batch = numbered_samples, plan, batch
        self.cursor, self._held = Cursor.parse(token, plan), None

    @property
    def token(self) -> str:
        return self.cursor.token()

    def next(self) -> list:
        """The rows of the batch in flight, in order; none at the end."""
        if self._held is None:
            rows = self.samples.filter((F.col("ordinal") >= self.cursor.ordinal) & (F.col("ordinal") < self.cursor.ordinal + self.batch))
            self._held = rows.orderBy("ordinal").collect()  # a batch
        return self._held

    def acknowledge(self) -> None:
        rows = self.next()
        if rows:
            self.cursor = self.cursor.moved(len(rows), len(rows), bytes(rows[-1]["sample_id"]).hex())
        self._held = None


def strict_json(text: str | bytes, limit: int = 16 << 20) -> dict:
    """A JSON object of bounded size without repeated keys."""
    if len(text.encode() if isinstance(text, str) else text) > limit:
        raise Refused("the document is too large")

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise Refused("a key is there twice")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=once)
