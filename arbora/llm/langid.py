"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, small_batches

#: Code points parsed side by side as one run; a phrase goes on from one block into the next (see parsed).
BLOCK = 512
_NEW = np.int32(1 << 30)


def normalised(text: str) -> str:
    """Letters lowered, every run of other characters one space."""
    return " ".join("".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(_Letters())).split(" ")).strip()


class _Letters(dict):
    def __missing__(self, c: int) -> str:
        return chr(c) if chr(c).isalpha() else " "


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text (state 0 is the root): it accepts exactly text's substrings."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """Automata of all languages in one transition table.

    A cell holds where a character leads (as an offset into the table) and, in bit 30, whether it starts
    a new phrase: it does at a root, and wherever the automaton has no such transition. Column 0 is
    the end of a text, 1 the space, 2 letters that the training text lacks.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t} - {" "})
        self.code = {c: i + 3 for i, c in enumerate(letters)} | {" ": 1}
        self.width = len(letters) + 3
        self.weight = np.array([math.log2(max(len(texts[x]), 2)) for x in self.langs])
        parts, self.roots = [], []
        at = 0
        for lang in self.langs:
            step = automaton(texts[lang])
            self.roots.append(at)
            t = np.full((len(step), self.width), -1, np.int64)
            for s, moves in enumerate(step):
                for c, to in moves.items():
                    t[s, self.code[c]] = at + to * self.width
            t[0] = np.where(t[0] < 0, at, t[0]) | int(_NEW)
            t = np.where(t < 0, t[0], t)
            t[:, 0] = at
            parts.append(t.astype(np.int32).ravel())
            at += t.size
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def codes(self) -> np.ndarray:
        """The column of each code point."""
        out = np.full(0x110000, 1, np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower() if len(x.lower()) == 1 else x
                out[c] = self.code.get(low, 2)
        return out


def parsed(lanes: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Phrases begun in each block (columns of lanes; first: blocks that begin a text) by language, in the greedy parse of whole texts.

    All blocks are parsed side by side as if each began a phrase. Then each goes on from where the block before it ended, until its
    states are those of the first parse, from where on the two are the same; blocks that end otherwise than before hand that on.
    """
    langs, blocks = len(model.langs), lanes.shape[1]
    roots = np.array(model.roots, np.int32)
    made = np.empty((len(lanes), langs, blocks), np.int32)
    state = np.repeat(roots[:, None], blocks, 1)
    for i, c in enumerate(lanes):
        made[i] = to = model.table.take(state + c)
        state = to & (_NEW - 1)
    follows = np.flatnonzero(~first)
    lang, block = np.repeat(np.arange(langs), len(follows)), np.tile(follows, langs)
    state = made[-1, lang, block - 1] & (_NEW - 1)
    apart = state != roots[lang]
    lang, block, state = lang[apart], block[apart], state[apart]
    while len(block):
        for i in range(len(lanes)):
            to = model.table.take(state + lanes[i, block])
            state = to & (_NEW - 1)
            apart = state != made[i, lang, block] & (_NEW - 1)
            made[i, lang, block] = to
            if not apart.all():
                lang, block, state = lang[apart], block[apart], state[apart]
                if not len(block):
                    break
        more = block + 1 < blocks  # these blocks end otherwise than before
        lang, block, state = lang[more], block[more] + 1, state[more]
        more = ~first[block]
        lang, block, state = lang[more], block[more], state[more]
    return (made >> 30).sum(axis=0)


def predict(texts: list[str], model: Model, columns: np.ndarray) -> list[tuple[str, float]]:
    """(language, score) of each text; ("und", 0.0) where a text has no letter."""
    rows, owner, chars, i = [], [], np.zeros(len(texts)), 0
    for i, text in enumerate(texts):
        c = columns[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = c == 1
        c = c[~(space & np.r_[True, space[:-1]])]  # one space for a run, none at the start
        if len(c) and c[-1] == 1:
            c = c[:-1]
        chars[i] = len(c)
        rows.append(np.pad(c, (0, -len(c) % BLOCK)))
        owner.append(np.full(len(rows[-1]) // BLOCK, i))
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    lanes = np.ascontiguousarray(np.concatenate(rows).reshape(-1, BLOCK).T) if len(owner) else np.zeros((0, 0), np.int32)
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    phrases = parsed(lanes, first, model) if len(owner) else np.zeros((len(model.langs), 0), np.int32)
    out = []
    totals = np.array([np.bincount(owner, weights=p, minlength=len(texts)) for p in phrases]).reshape(len(model.langs), len(texts))
    cost = totals * model.weight[:, None] / np.maximum(chars, 1)
    for i in range(len(texts)):
        if not chars[i] or not model.langs:
            out.append(("und", 0.0))
            continue
        order = np.argsort(cost[:, i], kind="stable")
        best = cost[order[0], i]
        second = cost[order[1], i] if len(order) > 1 else 0.0
        out.append((model.langs[order[0]], float(1 - best / second) if second > 0 else 1.0))
    return out


def training_texts(df: DataFrame, text: str, lang: str, doc_id: str, sample: int, chars: int) -> dict[str, str]:
    """Normalised training text by language: whole texts of about `sample` rows a language, chosen by a hash of doc_id, up to `chars` code points.

    The two parameters bound what the fit reads and what reaches the driver: ids and lengths of the
    sample, then the chosen texts. A text longer than the bound alone is cut to it.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").count()
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.withColumn("spot", spot).join(F.broadcast(counts), "lang").where(F.col("spot") < sample / F.col("count")).select("lang", "doc_id", "spot", F.length("text").alias("n")).collect()
    want, held = [], {}
    for r in sorted(chosen, key=lambda r: (r["spot"], str(r["doc_id"]))):
        if held.get(r["lang"], 0) < chars:
            held[r["lang"]] = held.get(r["lang"], 0) + r["n"]
            want.append(r["doc_id"])
    texts: dict[str, list] = {}
    if want:
        for r in rows.where(F.col("doc_id").isin(want)).select("lang", "doc_id", F.substring("text", 1, chars).alias("text")).distinct().collect():
            texts.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    return {k: t for k, v in texts.items() if (t := normalised(" ".join(dict.fromkeys(x for _, x in sorted(v))))[:chars])}


def identify(df: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", keep: list[str] | None = None, sample: int = 64, chars: int = 30_000) -> DataFrame:
    """The columns of `keep` (default: doc_id), lang_pred and score of every row of df.

    Cross-parsing: per language a suffix automaton holds all substrings of its training text; a text is cut
    greedily into the longest phrases found there, and the language
    with the fewest phrases, times log2 of its training length and per character, wins; ties go to
    the first name. score is one minus the ratio of the two lowest costs. Only `text` enters a prediction.

    Null texts and texts without letters are `und` with score 0, as is all if nothing can be learned. Nulls in
    `lang` or doc_id aren't learned from. Repeated rows get equal results; an empty table gives no rows.
    """
    keep = [doc_id] if keep is None else keep
    spark = df.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(Model(training_texts(train, text, lang, doc_id, sample, chars)))
    names = [f"c{i}" for i in range(len(keep))]
    given = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("body"))
    types = dict(given.dtypes)

    def run(batches):
        m = model.value
        cache = held("columns")
        if cache.get("code") != m.code:
            cache |= {"code": m.code, "columns": m.codes()}
        for b in batches:
            texts = [t or "" for t in b.column(len(names)).to_pylist()]
            got = []
            for a, z in slices(texts, 1 << 20):
                got += predict(texts[a:z], m, cache["columns"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    made = given.mapInArrow(run, ", ".join([f"{x} {types[x]}" for x in names] + ["lang_pred string, score double"]))
    return made.select(*[F.col(x).alias(c) for c, x in zip(keep, names, strict=True)], "lang_pred", "score")
