"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, released, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Scores at which whole pieces are used up and single characters are made.
NEVER, FIRST = float("-inf"), float("inf")
#: Parts (see packed) that a worker remembers, twice over; longer parts aren't remembered, nor parts met once (by SEEN marks, dealt by hash).
MEMORY, LONGEST_HELD, SEEN = 150_000, 48, 1 << 20
#: Pairs of pieces that a worker remembers.
PAIRS = 300_000


class Vocabulary:
    """The pieces of a SentencePiece model, and decoding. Models whose normaliser changes texts beyond the spaces are refused."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.proto = m = pb.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model's normaliser changes texts; only identity models with escaped spaces are encoded")
        if m.trainer_spec.model_type not in (1, 2) or any(p.type == 4 for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined symbols are encoded")
        self.bpe = m.trainer_spec.model_type == 2
        self.prefix = n.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        self.raw = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in m.pieces]

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        s = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return s[1:] if self.prefix and s.startswith(" ") else s


class Pieces(Vocabulary):
    """The search.

    One automaton over all pieces (a trie with failure links) tells which pieces end at each position. Unigram
    models: the best path adds piece scores. BPE models: a path is alive if each two neighbouring
    pieces are what the merge order makes of their concatenation; that leaves exactly one live
    predecessor per position and its path equals the merges' result. Characters outside the vocabulary
    become byte pieces, or the unknown piece in models without bytes.
    """

    def __init__(self, model: bytes, memory: int = MEMORY):
        super().__init__(model)
        m = self.proto
        self.proto = None
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.longest = max(map(len, self.ids), default=1)
        self.low = min(self.score.values(), default=0.0) - 10.0  # of an unknown character
        #: In BPE, the two pieces of the last merge that makes a piece, and the score at which it is made.
        self.halves, self.made = {}, {}
        for p in self.ids:
            if self.bpe and len(p) > 1:
                self.merged(p, last := [])
                if last and len(last[0] + last[1]) == len(p):
                    self.halves[p], self.made[p] = tuple(last), self.score[p]
        #: Pieces with a merge in them that scores no worse than one before it.
        self.uneven = set()
        for p in sorted(self.halves, key=len):
            if any(h in self.uneven or self.made.get(h, FIRST) <= self.made[p] for h in self.halves[p]):
                self.uneven.add(p)
        self.automaton([p for p in self.ids if not self.bpe or len(p) == 1 or p in self.halves])
        #: No piece holds a space mark after another character: all paths meet before each run of marks.
        self.split = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        #: Parts of a text (see packed): letters, the marks (P) that stand beside no letter in any piece, or whatever stands between two spaces.
        beside = {c for p in self.ids for c, d in [*zip(p, p[1:]), *zip(p[1:], p)] if d.isalpha()}
        marks = "".join(re.escape(c) for c in sorted({c for p in self.ids for c in p if not (c.isalnum() or c == "_" or c == SPACE)} - beside | set("\n\t")))
        letters = r"[^\W\d_]"
        self.parts = re.compile(rf" *(?:{letters}++(?=[{marks} ]|\Z)|[{marks}]++(?={letters}| |\Z)|[^ ]+)| +" if self.bytes else " *[^ ]+| +")
        self.sizes = [max(1, len(p)) for p in self.pieces] + [1]  # the last one, at -1, is of an unknown character
        self.pairs, self.paired = [{} for _ in self.pieces], 0
        self.known, self.old, self.memory, self.seen = {}, {}, memory, bytearray(SEEN)

    def automaton(self, pieces: list[str]) -> None:
        """By state: where characters lead, the state of the longest proper suffix, and (id, length) of the pieces that end there, longest first."""
        self.moves, self.fail, self.ends = [{}], [0], [()]
        for p in pieces:
            state = 0
            for c in p:
                to = self.moves[state].get(c)
                if to is None:
                    to = self.moves[state][c] = len(self.moves)
                    self.moves.append({})
                    self.fail.append(0)
                    self.ends.append(())
                state = to
            self.ends[state] = ((self.ids[p], len(p)),)
        none: dict = {}
        queue = [0]
        for state in queue:
            for c, to in self.moves[state].items():
                queue.append(to)
                if state:
                    back = self.fail[state]
                    while back and c not in self.moves[back]:
                        back = self.fail[back]
                    self.fail[to] = self.moves[back].get(c, 0)
                below = self.ends[self.fail[to]]
                self.ends[to] = self.ends[to] + below if self.ends[to] else below
        self.moves = [x or none for x in self.moves]

    def merged(self, s: str, last: list | None = None) -> list[str]:
        """The merge order's pieces of s: the best-scored neighbours first, the leftmost on ties; `last` takes the last two merged."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            if last is not None:
                last[:] = parts[at : at + 2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joined(self, a: int, b: int) -> bool:
        """Whether the merge order makes pieces a, b of their concatenation."""
        self.paired += 1
        if self.paired > PAIRS:
            for row in self.pairs:
                row.clear()
            self.paired = 0
        x, y = self.pieces[a], self.pieces[b]
        even = x not in self.uneven and y not in self.uneven
        ok = self.pairs[a][b] = self.apart(x, y) if even else self.merged(x + y) == [x, y]
        return ok

    def apart(self, x: str, y: str) -> bool:
        """Whether no merge crosses from x to y, by undoing their merges from the last one back (both even).

        Visits all pairs of neighbours that existed together while x and y were made. A pair merges if that scores better
        than the merges that took its members away; where equal, the leftmost merge is first.
        """
        score, made, halves = self.score.get, self.made.get, self.halves
        left = right = NEVER  # the scores at which x and y were used up
        while True:
            both = score(x + y)
            if both is not None and both > left and both >= right:
                return False
            at_x, at_y = made(x, FIRST), made(y, FIRST)
            if at_x < at_y:
                x, left = halves[x][1], at_x
            elif at_y < FIRST:
                y, right = halves[y][0], at_y
            else:
                return True

    def commits(self, s: str):
        """Streaming Viterbi over s: yields lists of ids as soon as they are certain.

        Keeps, from the last boundary on, the piece that ends at each position (so its backpointer) and the scores, at most
        twice the longest piece. Whenever the window is full, the live paths (those that end where a piece may still start) are
        walked back until they meet in one boundary; what is before it is yielded and forgotten. Paths that don't meet yet keep the window.
        """
        moves, fail, ends, pairs, bpe, longest = self.moves, self.fail, self.ends, self.pairs, self.bpe, self.longest
        state = base = at = 0
        full = 2 * longest
        last, best = [-1], [0.0]  # by position from base on: the piece that ends there (-1: none, or an unknown character), the path's score
        for c in s:
            to = moves[state].get(c)
            while to is None and state:
                state = fail[state]
                to = moves[state].get(c)
            state = to or 0
            at += 1
            piece = -1
            if bpe:
                for k, n in ends[state]:
                    if n > at:
                        continue
                    before = last[at - n]
                    if before >= 0:
                        ok = pairs[before].get(k)
                        if ok is None:
                            ok = self.joined(before, k)
                        if not ok:
                            continue
                    piece = k
                    break
            else:
                top = best[at - 1] + self.low if c not in self.ids else NEVER
                for k, n in ends[state]:
                    if n <= at and (x := best[at - n] + self.score[self.pieces[k]]) > top:
                        top, piece = x, k
                best.append(top)
            last.append(piece)
            if at >= full:
                alive, sizes = set(range(at + 1 - longest, at + 1)), self.sizes
                while len(alive) > 1:  # walk the latest of the live positions back until all have met
                    p = max(alive)
                    alive.discard(p)
                    alive.add(p - sizes[last[p]])
                meet = alive.pop()
                if meet:
                    yield self.walked(s, base, last, meet)
                    base, at, last, best, full = base + meet, at - meet, last[meet:], best[meet:], 2 * longest
                else:
                    full = at + longest
        yield self.walked(s, base, last, at)

    def walked(self, s: str, base: int, last: list, i: int) -> list[int]:
        """The ids on the path from the window's start to position i."""
        out, sizes = [], self.sizes
        while i > 0:
            piece = last[i]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[x] for x in reversed(s[base + i - 1].encode("utf-8", "replace"))]
            else:
                out.append(self.unknown)
            i -= sizes[piece]
        out.reverse()
        return out

    def segment(self, s: str) -> bytes:
        """The packed ids of s."""
        out = array("i")
        for ids in self.commits(s):
            out.extend(ids)
        if not self.bytes:  # neighbouring unknown characters are one piece
            out = array("i", [x for k, x in enumerate(out) if x != self.unknown or not k or out[k - 1] != x])
        return out.tobytes()

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers.

        All paths meet before a space mark, and between characters that stand side by side in no piece; so the search restarts at some of these
        boundaries, and its result for a part between two of them may be taken from memory: a cache of bounded size, which changes nothing but time.
        """
        if not text:
            return b""
        s = (" " if self.prefix else "") + text.replace(SPACE, " ")
        if not self.split:
            return self.segment(s.replace(" ", SPACE))
        parts = self.parts.findall(s)
        out = list(map(self.known.get, parts))
        if None in out:
            out = [self.part(x) if ids is None else ids for x, ids in zip(parts, out, strict=True)]
        return b"".join(out)

    def part(self, part: str) -> bytes:
        """The ids of a part; it is held from the second time on, and what the older half of the memory holds moves to the newer."""
        ids = self.known.get(part)
        if ids is None:
            ids, again = self.old.get(part), True
            if ids is None:
                ids = self.segment(part.replace(" ", SPACE))
                slot = hash(part) & SEEN - 1
                again, self.seen[slot] = self.seen[slot], 1
            if again and len(part) <= LONGEST_HELD:
                if len(self.known) >= self.memory:
                    self.old, self.known, self.seen = self.known, {}, bytearray(SEEN)
                self.known[part] = ids
        return ids


#: What this module's tasks hold in a worker.
OWN = (Vocabulary.__name__, Pieces.__name__)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _loaded(kind: type, model: bytes, **given):
    """The model as this worker holds it, with what it remembers; one model of a kind at a time."""
    loaded = held(kind.__name__)
    if loaded.get("model") != (model, given):
        loaded |= {"model": (model, given), "made": kind(model, **given)}
    return loaded["made"]


def lists(pieces: Pieces, texts: pa.Array) -> pa.Array:
    """The ids of an Arrow array of texts as lists; null for null."""
    made, ends, end = [], [], 0
    for t in texts:
        t = t.as_py()
        ends.append(None if t is None else end)
        if t is not None:
            made.append(ids := pieces.packed(t))
            end += len(ids) // 4
    values = pa.Array.from_buffers(pa.int32(), end, [None, pa.py_buffer(b"".join(made))])
    return pa.ListArray.from_arrays(pa.array([*ends, end], pa.int32()), values)


def encode(df: DataFrame, text: str = "text", model: str = MODEL, out: str = "ids", memory: int = MEMORY) -> DataFrame:
    """df and `out` (array<int>): each text's ids. Null texts give null, empty ones no ids; a column named `out` is replaced.
    `memory` is how many parts a worker remembers, twice over: fewer take less of its memory and more time, with the same ids.

    The model file (under 1 MB) is read on the driver and sent with the tasks. Texts pass through
    Python one by one; a worker holds one batch, a bounded memory of short segments, and the search's window.
    """
    small_batches(df.sparkSession)
    body = df.sparkSession.sparkContext.broadcast(read_model(model))
    keep = [c for c in df.columns if c != out]
    names = [f"c{i}" for i in range(len(keep))]
    at = keep.index(text) if text in keep else len(keep)  # a text that is returned is sent once
    given = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)], *[F.col(f"`{text}`").alias("body")][: at == len(keep)])
    types = dict(given.dtypes)

    def run(batches):
        pieces = _loaded(Pieces, body.value, memory=memory)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], lists(pieces, b.column(at))], names=[*names, "ids"])

    made = given.mapInArrow(lambda batches: released(run(batches), OWN), ", ".join([f"{x} {types[x]}" for x in names] + ["ids array<int>"]))
    return made.select(*[F.col(x).alias(c) for c, x in zip(keep, names, strict=True)], F.col("ids").alias(out))


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL, out: str = "text") -> DataFrame:
    """df and `out`: the text of each array of ids; null for null. A column named `out` is replaced."""
    small_batches(df.sparkSession)
    body = df.sparkSession.sparkContext.broadcast(read_model(model))
    keep = [c for c in df.columns if c != out]
    names = [f"c{i}" for i in range(len(keep))]
    given = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)], F.col(f"`{ids}`").alias("body"))
    types = dict(given.dtypes)

    def run(batches):
        pieces = _loaded(Vocabulary, body.value)
        for b in batches:
            lists = b.column(len(names))
            flat, ends = lists.values.to_numpy().tolist(), lists.offsets.to_pylist()
            texts = pa.array([pieces.decode(flat[ends[i] : ends[i + 1]]) if ok else None for i, ok in enumerate(lists.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*names, "text"])

    made = given.mapInArrow(lambda batches: released(run(batches), OWN), ", ".join([f"{x} {types[x]}" for x in names] + ["text string"]))
    return made.select(*[F.col(x).alias(c) for c, x in zip(keep, names, strict=True)], F.col("text").alias(out))
