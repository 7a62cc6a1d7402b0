"""Operator 4: language identification by prediction by partial matching.

Each learned language has a byte context tree of orders 0 to 3, with escape probabilities by method C (an unseen byte
gets the share d / (n + d) of a context seen n times with d different bytes, divided among the bytes unseen there in
proportion to the next shorter context, which makes all code lengths those of proper distributions). Statistics are
frozen after training; the code length of a text is the exact sum over its bytes, of the whole text, for every
language, and the shortest wins. All 256 byte values are symbols (A-Z are lower-cased).

Training: every language of the training rows is learned. The trees are counted on labelled rows whose hash of the id
falls under their language's threshold; thresholds let about FIT_ROWS rows through in all (all rows if there are fewer),
and as many of each language, or all of its rows if it has fewer; the least hash of a language always passes. Rows of the held-out third (crc32 of the id as text, mod 3, is
1) and rows without a language or id are never used. The counts have one row for each different (order + 1)-gram that a
language was seen with; workers turn them into sorted arrays once, of the grams and contexts seen at each order, so that
memory grows with what training saw and not with the number of possible contexts.

A null text, or one without a letter, is ``und`` with score 0; without training rows all texts are ``und``. Ties go to
the language first in alphabetical order. Repeated rows give repeated rows. Null ids are not held out.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import BLOCK_BYTES, ascii_lower, map_texts, read

#: Expected number of labelled rows that the model is fitted on.
FIT_ROWS = 20_000
#: Values of the hash that rows are drawn by.
DRAWS = 1 << 20
ORDER = 3
#: Bytes of text whose code lengths are looked up at a time.
PIECE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(ascii_lower(text).encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)


class Tree:
    """One language's contexts: for each order the grams seen with their code lengths, and the contexts with those of an escape."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order in range(ORDER + 1 if len(codes) else 0):
            seen, place = np.unique(codes & _mask(order + 1), return_inverse=True)
            n = np.bincount(place, counts)
            context, place = np.unique(seen >> np.uint32(8), return_inverse=True)
            total, different = np.bincount(place, n), np.bincount(place)
            # what the next shorter context leaves to the bytes unseen here
            rest = 1 - np.bincount(place, np.exp2(-self.bits(seen & _mask(order))))
            escapes = different < 256
            rest = np.where(escapes, rest, 1)
            share = n / np.where(escapes, total + different, total)[place]
            self.orders.append((seen, -np.log2(share), context, np.log2(rest * (total + different) / different)))
        self.orders = [(g, b.astype(np.float32), c, e.astype(np.float32)) for g, b, c, e in self.orders]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram: of the longest context that has seen it, and of the escapes from longer ones."""
        out = np.full(len(codes), 8.0)
        for order, (seen, length, context, escape) in enumerate(self.orders):
            gram = codes & _mask(order + 1)
            at, known = _find(context, gram >> np.uint32(8))
            out[known] += escape[at[known]]
            at, known = _find(seen, gram)
            out[known] = length[at[known]]
        return out


def _mask(n: int) -> np.uint32:
    """Of the last ``n`` bytes of a gram."""
    return np.uint32((1 << 8 * n) - 1)


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


class Model:
    """Counts of (order + 1)-grams by language, frozen."""

    size = 256

    def __init__(self, languages: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages, self.grams = languages, grams
        self.key = uuid.uuid4().hex

    def trees(self) -> list[Tree]:
        return [Tree(*self.grams[x]) for x in self.languages]

    def lengths(self) -> np.ndarray:
        """Code length in bits of each byte after each context that any language has seen: array [(order + 1)-gram, language]."""
        context = np.unique(np.concatenate([self.grams[x][0] >> np.uint32(8) for x in self.languages]))
        codes = (context[:, None] << np.uint32(8) | np.arange(256, dtype=np.uint32)).reshape(-1)
        return np.stack([t.bits(codes).astype(np.float32) for t in self.trees()], axis=1)


_trees: dict[str, list[Tree]] = {}


def _compiled(model: Model) -> list[Tree]:
    """The model's trees, made once in a worker; another model's replace them."""
    if model.key not in _trees:
        _trees.clear()
        _trees[model.key] = model.trees()
    return _trees[model.key]


def grams(text: np.ndarray) -> np.ndarray:
    """(order + 1)-grams of a text's bytes as numbers, begun as if after zero bytes."""
    lead = np.concatenate([np.zeros(ORDER, np.uint8), text])
    out = np.zeros(len(text), np.uint32)
    for i in range(ORDER + 1):
        out = out << np.uint32(8) | lead[i : i + len(text)]
    return out


def _train_counts(rows: DataFrame, lang: str, text: str, languages: list[str]) -> DataFrame:
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        import pyarrow as pa

        from lumenframe.llm.common import blocks

        for block in blocks(batches, text, BLOCK_BYTES):
            held: dict[int, list[np.ndarray]] = {}
            for one, t in zip(block.column(lang).to_pylist(), block.column(text).to_pylist()):
                if one in place and t:
                    held.setdefault(place[one], []).append(grams(_bytes(t)))
            for k, parts in held.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return rows.select(lang, text).mapInArrow(run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _share(counts: list[int], total: int) -> float:
    """The bound for which the counts, cut at it, add up to ``total``."""
    left = sorted(counts)
    while left and left[0] * len(left) <= total:
        total -= left.pop(0)
    return total / len(left) if left else math.inf


def train(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows outside the held-out third; about ``fit_rows`` of them at most, or one a language."""
    usable = F.col(id_col).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) > 0) & ~held_out(id_col)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(DRAWS))
    rows = df.where(usable).select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    known = sorted(tuple(r) for r in rows.groupBy("lang").agg(F.count(F.lit(1)), F.min("draw")).collect())
    languages = [x for x, _, _ in known]
    if not languages:
        return Model([], {})
    if sum(n for _, n, _ in known) > fit_rows:
        most = _share([n for _, n, _ in known], fit_rows)
        limits = [(x, max(first + 1, math.ceil(min(1, most / n) * DRAWS))) for x, n, first in known]
        kind = T.StructType([T.StructField("lang", rows.schema["lang"].dataType), T.StructField("below", T.LongType())])
        rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(limits, kind)), "lang").where("draw < below")
    got = _train_counts(rows, "lang", "text", languages).toArrow()
    which, code, n = (got.column(c).to_numpy() for c in ("lang", "gram", "n"))
    by = np.lexsort((code, which))
    which, code, n = which[by], code[by].astype(np.uint32), n[by]
    edge = np.searchsorted(which, np.arange(len(languages) + 1))
    return Model(languages, {x: (code[a:b], n[a:b]) for x, a, b in zip(languages, edge, edge[1:])})


def code_lengths(trees: list[Tree], texts: list[str | None]) -> np.ndarray:
    """Bits of each text in each language; each different gram of a piece is looked up once."""
    out = np.zeros((len(texts), len(trees)))
    held: list[tuple[int, np.ndarray]] = []

    def look_up():
        code, place = np.unique(np.concatenate([x for _, x in held]), return_inverse=True)
        begin = np.cumsum([0] + [len(x) for _, x in held[:-1]])
        owner = [i for i, _ in held]
        for k, tree in enumerate(trees):
            np.add.at(out[:, k], owner, np.add.reduceat(tree.bits(code)[place], begin))
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        code = grams(_bytes(t))
        for at in range(0, len(code), PIECE):
            held.append((i, code[at : at + PIECE]))
            size += len(held[-1][1])
            if size >= PIECE:
                look_up()
                size = 0
    if held:
        look_up()
    return out


def score_block(model: Model, trees: list[Tree], texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {"lang_pred": [], "score": [], "bits_per_byte": []}
    read = [t if t and model.languages and _LETTER.search(t) else None for t in texts]
    for t, bits in zip(read, code_lengths(trees, read)):
        if t is None:
            pred, score, rate = "und", 0.0, None
        else:
            best = int(np.argmin(bits))
            # the posterior of the winner under equal priors
            pred, score, rate = model.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / len(_bytes(t)))
        out["lang_pred"].append(pred)
        out["score"].append(score)
        out["bits_per_byte"].append(rate)
    return out


def predict(df: DataFrame, model: Model, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep``, lang_pred, score (posterior), bits_per_byte. A narrow map."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = _compiled(sent.value)
        return lambda texts: score_block(sent.value, trees, texts)

    return map_texts(df, text, None, "lang_pred string, score double, bits_per_byte double", keep, make=make)


def lettered(df: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` and lettered: whether the text has a letter, which every text with a prediction has."""
    return map_texts(df, text, lambda texts: {"lettered": [bool(t and _LETTER.search(t)) for t in texts]}, "lettered boolean", keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")
