"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

An Aho-Corasick automaton over the vocabulary gives, for each position, the matching pieces from the
longest down. A piece is taken if it is compatible with the piece before it: merging the two pieces'
characters again, by the model's scores, must give the same two pieces. Where nothing fits, the position
goes into a bitfield of failed positions and the piece before it is taken back for its next shorter match.

Defined results: a null text is an empty one and has no ids; characters outside the vocabulary become byte
pieces, or the unknown id without byte fallback; repeated rows give repeated results; further columns stay.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.spool import arrow_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The (number, value) pairs of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[i : i + n]
            i += n


def read_model(data: bytes) -> dict:
    """Pieces, scores, types and the normaliser's switches of a serialised model."""
    import struct

    pieces, spec, trainer = [], {}, {}
    for k, v in _fields(data):
        if k == 1:
            f = dict(_fields(v))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif k == 2:
            trainer = dict(_fields(v))
        elif k == 3:
            spec = dict(_fields(v))
    if trainer.get(3) != 2:
        raise ValueError("only merge-type (BPE) models are supported")
    if spec.get(2) or any(t == USER for _, _, t in pieces) or trainer.get(24):
        raise ValueError("character maps, user-defined symbols and white space suffixes are not supported")
    return {"pieces": pieces, "dummy_prefix": spec.get(3, 1), "squeeze": spec.get(4, 1), "escape": spec.get(5, 1), "digest": hashlib.sha256(data).hexdigest()}


class Codec:
    """Encodes and decodes with one model; caches are bounded."""

    WORDS, PAIRS, LONGEST = 160_000, 300_000, 200

    def __init__(self, model: dict):
        import ahocorasick

        self.model, self.pieces = model, model["pieces"]
        self.rank = {p: (-s, i) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, UNUSED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.value = {i: bytes([b]) for b, i in self.bytes.items()}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.automaton = ahocorasick.Automaton()
        #: Pieces that merging can arrive at.
        self.own = {p: i for p, (_, i) in self.rank.items() if self.merge(p) == [p]}
        for p, i in self.own.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.plain = 1 + max(i for i, p in enumerate(self.pieces) if p[2] not in (NORMAL, UNUSED))
        self.sizes = [len(p) for p, _, _ in self.pieces]
        #: Neighbouring characters of pieces: between any others nothing merges, so a text can be cut there.
        self.joined = {p[k : k + 2] for p in self.own for k in range(len(p) - 1)}
        #: No piece has a space mark after another character, so the text can be cut before such marks.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        line = "" if any("\n" in p for p in self.own) else "\n"
        self.tokens = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}+" if line else "")).findall
        self.prefix: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)

    def normal(self, text: str) -> str:
        if self.model["squeeze"]:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.model["dummy_prefix"]:
            text = " " + text
        return text.replace(" ", SPACE) if self.model["escape"] else text

    def merge(self, text: str) -> list[str]:
        """The reference procedure: merge the best-scored adjacent pair, the leftmost of equals, until none is left."""
        part, n = list(text), len(text)
        if n <= 48:
            never, best = (float("inf"), 0), self.rank.get
            ranks = [best(text[k : k + 2], never)[0] for k in range(n - 1)]
            while ranks and (r := min(ranks)) != never[0]:
                k = ranks.index(r)
                part[k : k + 2] = [part[k] + part[k + 1]]
                del ranks[k]
                if k < len(ranks):
                    ranks[k] = best(part[k] + part[k + 1], never)[0]
                if k:
                    ranks[k - 1] = best(part[k - 1] + part[k], never)[0]
            return part
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(a: int) -> None:
            if a >= 0 and (b := after[a]) < n and (r := self.rank.get(part[a] + part[b])):
                heapq.heappush(heap, (r[0], a, part[a] + part[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, whole = heapq.heappop(heap)
            b = after[a]
            if not part[a] or b >= n or part[a] + part[b] != whole:
                continue
            part[a], part[b] = whole, ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [p for p in part if p]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        left, right = self.pieces[a][0], self.pieces[b][0]
        got = self.pairs[a << 20 | b] = self.merge(left + right) == [left, right]
        return got

    def shorter(self, i: int) -> int:
        """The longest piece that is a proper prefix of piece i, or -1."""
        if (got := self.prefix.get(i)) is None:
            p = self.pieces[i][0]
            got = self.prefix[i] = next((self.own[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.own), -1)
        return got

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        n = len(text)
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(text):
            longest[end + 1 - size] = i  # of one start, the automaton meets the longest match last
        sizes, pairs = self.sizes, self.pairs
        failed, out, at, i, last = 0, [], 0, longest[0], -1
        while True:
            while i >= 0:
                if not failed >> (at + sizes[i]) & 1:
                    if last < 0:
                        break
                    ok = pairs.get(last << 20 | i)
                    if self.compatible(last, i) if ok is None else ok:
                        break
                i = self.shorter(i)
            if i >= 0:
                out.append(i)
                at += sizes[i]
                if at == n:
                    return out
                last, i = i, longest[at]
            else:
                failed |= 1 << at
                i = out.pop()
                at -= sizes[i]
                last = out[-1] if out else -1
                i = self.shorter(i)

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode_part(self, part: str) -> list[int]:
        """Ids of normalised text. Equal scores leave runs of spaces to the merge procedure itself."""
        out: list[int] = []
        if SPACE * 2 in part:
            for p in self.merge(part):
                out += [self.rank[p][1]] if p in self.rank else self.spell(p)
            return out
        lo, joined, rank = 0, self.joined, self.rank
        for hi in range(1, len(part) + 1):
            if hi < len(part) and part[hi - 1 : hi + 1] in joined:
                continue
            unit = part[lo:hi]
            lo = hi
            if len(unit) == 1:
                out += [rank[unit][1]] if unit in rank else self.spell(unit)
                continue
            out += self.backtrack(unit)
        return out

    def parts(self, normal: str) -> list[str]:
        """The normalised text cut where no piece can cross."""
        if not normal:
            return []
        if not self.cuts:
            return [normal]
        return self.tokens(normal)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(self.normal(text)) for i in self.encode_part(p)]

    def pieces_text(self, ids: list[int]) -> str:
        """The ids' text before the first space is dropped; byte pieces that are no UTF-8 become U+FFFD."""
        if min(ids, default=0) >= self.plain:
            return "".join([self.pieces[i][0] for i in ids]).replace(SPACE, " ")
        out, raw = [], b""
        for i in [*ids, None]:
            if i in self.value:
                raw += self.value[i]
                continue
            if raw:
                out.append(_lenient(raw))
                raw = b""
            if i is not None and self.pieces[i][2] != CONTROL:
                out.append(" ⁇ " if self.pieces[i][2] == UNKNOWN else self.pieces[i][0].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        first = next((self.pieces[i] for i in ids if self.pieces[i][2] != CONTROL), ("", 0.0, CONTROL))
        return text[1:] if self.model["dummy_prefix"] and first[0][:1] == SPACE and first[2] == NORMAL else text

    def round_trip(self, text: str) -> tuple[str, int, str]:
        """Comma-joined ids, their number and the decoded text; each part's ids are kept for its next use."""
        normal = self.normal(text)
        parts = self.parts(normal)
        if not parts:
            return "", 0, ""
        if self.model["dummy_prefix"]:
            got = [*map(self.words.__getitem__, parts)]
            try:
                ids, text = ",".join(got), normal.replace(SPACE, " ")
            except TypeError:  # some part decodes to another text than its own
                ids = ",".join([g if isinstance(g, str) else g[0] for g in got])
                text = "".join([p.replace(SPACE, " ") if isinstance(g, str) else g[1] for p, g in zip(parts, got, strict=True)])
            return ids, ids.count(",") + 1, text[1:] if text[:1] == " " else text
        out = [i for p in parts for i in self.encode_part(p)]
        return ",".join(map(str, out)), len(out), self.decode(out)


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every byte that is not part of a character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


class _Words(dict):
    """part -> comma-joined ids, or (ids, decoded text) where that text is not the part itself; bounded, and long parts are
    not kept."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.older: dict[str, str | tuple[str, str]] = {}

    def __missing__(self, part: str) -> str | tuple[str, str]:
        c = self.codec
        if (got := self.older.pop(part, None)) is None:
            if 2 < len(part) <= c.LONGEST and part[-2:] not in c.joined and SPACE * 2 not in part:  # a mark after a word
                two = [(x, p.replace(SPACE, " ")) if isinstance(x := self[p], str) else x for p in (part[:-1], part[-1])]
                ids, text = f"{two[0][0]},{two[1][0]}", two[0][1] + two[1][1]
            else:
                pieces = c.encode_part(part)
                ids, text = ",".join(map(str, pieces)), c.pieces_text(pieces)
            got = ids if text == part.replace(SPACE, " ") else (ids, text)
        if len(part) <= c.LONGEST:
            if len(self) >= c.WORDS:  # what is still in use comes back from the older half
                self.older = dict(self)
                self.clear()
            self[part] = got
        return got


_CODECS: dict[str, Codec] = {}


def codec(model: dict) -> Codec:
    """One codec for each model and process."""
    if model["digest"] not in _CODECS:
        _CODECS.clear()
        _CODECS[model["digest"]] = Codec(model)
    return _CODECS[model["digest"]]


def load(path: str) -> dict:
    with open(path, "rb") as f:
        return read_model(f.read())


def _append(batch: pa.RecordBatch, drop: str | None, **columns: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != drop and n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns.values()], [*kept, *columns])


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array<int> of ids in place of the text; `ids` replaces a column of that name."""
    model = load(model_path)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            out = [[int(i) for i in got.split(",")] if (got := c.round_trip(t or "")[0]) else [] for t in b.column(text).to_pylist()]
            yield _append(b, text, **{ids: pa.array(out, pa.list_(pa.int32()))})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in (text, ids)]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{ids}` array<int>"]))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The inverse of encode(): a string column in place of the ids; null ids are an empty text."""
    model = load(model_path)
    arrow_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield _append(b, ids, **{text: pa.array([c.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name not in (text, ids)]
    return encoded.mapInArrow(run, ", ".join([*fields, f"`{text}` string"]))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    model = load(model_path)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            got = [c.round_trip(t.as_py() or "") for t in b.column("text")]
            sha = [[hashlib.sha256(g[k].encode("utf-8", "surrogatepass")).hexdigest() for g in got] for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[1] for g in got], pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
