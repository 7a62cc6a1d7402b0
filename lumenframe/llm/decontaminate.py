"""Operator 2: benchmark decontamination by a distributed positional inverted index.

The index is a stored table with a row for each shard, a block of documents: its terms, and for every term the sorted
positions of its occurrences, of all words of all documents. It is written once to the shared folder; every search reads
it from there. Queries are windows of ten consecutive item words. A window starts with the postings of the term that is
rarest in the shard, adjusted by the term's offset, and intersects them with the other terms' adjusted postings, rarest
first; what is left are exact occurrences. Proximity matches are windows whose three rarest different terms stand in one
document, the second and third within SLOP positions of the first, in any order. Rarity is a term's number of
occurrences in all documents, summed over the index; terms that occur nowhere are left out, ties go to the alphabet. So
matches don't depend on how documents fall into shards.

All windows are asked of every shard, in groups of at most QUERY_BYTES of item text: one group is the usual case. The
driver holds one group at a time; its size is checked before it is sent, and it is taken back from the executors before
the next one is read. With several groups each one's matches are written, and joined by document at the end.

Null and empty texts have no words: no hits. Null items have no windows; repeated item ids count once, null ids as an
item without a name (not counted). Windows that tie in rarity are ordered by the alphabet. Repeated documents give
repeated rows; an empty table gives none, an empty benchmark hits nothing. A very long text is a shard of its own. Kept
columns may have any names; ``match`` comes after them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import arrow_schema, blocks, materialize, new_path, parted, quoted, read, words_of

WINDOW = 10
SLOP = 20
QUERY_BYTES = 16 << 20
#: Bytes of text in a shard of the index.
SHARD_BYTES = 4 << 20
#: Bytes of a row group of the index: what a reader holds of it at once.
GROUP_BYTES = 32 << 20
MATCH = "n_words bigint, ranges array<array<bigint>>, items array<string>, near array<string>"


class Windows:
    """A group's windows: terms by number, and for each window its terms (padded with 0) and its item."""

    def __init__(self, items: list[tuple[str, str]], occurs: dict[str, int] | None = None):
        self.terms: dict[str, int] = {}
        rows, owner, self.names = [], [], [name for name, _ in items]
        seen: dict[tuple[int, ...], int] = {}
        for k, (_, text) in enumerate(items):
            ids = [self.terms.setdefault(w, len(self.terms) + 1) for w in words_of(text)]
            for i in range(max(len(ids) - WINDOW, 0) + 1 if ids else 0):
                w = tuple(ids[i : i + WINDOW])
                # equal windows of different items are asked once
                owner.append((seen.setdefault(w, len(rows)), k))
                if seen[w] == len(rows):
                    rows.append(w)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.words = np.array([r + (0,) * (WINDOW - len(r)) for r in rows], np.int64).reshape(-1, WINDOW)
        self.owner = np.array(sorted(set(owner)), np.int64).reshape(-1, 2)
        self.triples, self.triple_owner = self._rarest(occurs if occurs is not None else {})

    def _rarest(self, occurs: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The three rarest different terms of windows, rarest first, each three once; (three, item) of those that ask for it."""
        present = sorted((n, w) for w, n in occurs.items() if n and w in self.terms)
        rank = np.full(len(self.terms) + 1, len(present), np.int64)
        rank[[self.terms[w] for _, w in present]] = np.arange(len(present))
        ranked = np.sort(rank[self.words], axis=1)
        # repeats of a term, padding and terms without an occurrence come last
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = len(present)
        rarest = np.sort(ranked, axis=1)[:, :3]
        asked = rarest[:, 2] < len(present) if len(rarest) else np.zeros(0, bool)
        term = np.array([self.terms[w] for _, w in present], np.int64)
        triples, place = np.unique(rarest[asked], axis=0, return_inverse=True)
        of_window = np.full(len(self.words), -1)
        of_window[asked] = place.reshape(-1)
        pairs = np.stack([of_window[self.owner[:, 0]], self.owner[:, 1]], axis=1)
        return term[triples] if len(triples) else np.zeros((0, 3), np.int64), np.unique(pairs[pairs[:, 0] >= 0], axis=0)


class _Numbered(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _begins(n_words: np.ndarray) -> np.ndarray:
    """Where each document of a shard begins; a gap before each lets no window cross from one to the next."""
    return np.cumsum(n_words + WINDOW) - n_words


def postings(texts: list[str | None]) -> tuple[list[int], str, bytes, bytes]:
    """A block's words by document, its terms (a line each), where each one's postings end, and the postings as differences."""
    number = _Numbered()
    docs = [np.fromiter(map(number.__getitem__, words_of(t)), np.int32) for t in texts]
    n_words = np.array([len(d) for d in docs], np.int64)
    term = np.concatenate([np.zeros(0, np.int32), *docs])
    at = np.arange(len(term)) + np.repeat(_begins(n_words) - (np.cumsum(n_words) - n_words), n_words)
    by = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(number)))
    return n_words.tolist(), "\n".join(number), ends.astype("<i4").tobytes(), np.diff(at[by], prepend=0).astype("<i4").tobytes()


class Shard:
    """A shard's postings of the terms that are asked for; positions run on from document to document."""

    def __init__(self, n_words: list[int], terms: str, ends: bytes, differences: bytes, asked: dict[str, int]):
        self.n_words = np.array(n_words, np.int64)
        self.start = _begins(self.n_words)
        self.span = int(self.n_words.sum()) + WINDOW * (len(n_words) + 1)
        at = np.cumsum(np.frombuffer(differences, "<i4"), dtype=np.int64)
        end = np.frombuffer(ends, "<i4").astype(np.int64)
        own = {w: i for i, w in enumerate(terms.split("\n"))} if len(end) else {}
        place = np.fromiter((own.get(w, -1) for w in asked), np.int64, len(asked))
        n = np.zeros(len(asked) + 2, np.int64)  # by number of the term, which counts from 1
        held = place[place >= 0]
        low = np.append(0, end)[held]
        n[1:-1][place >= 0] = end[held] - low
        self.first = np.append(0, np.cumsum(n)[:-1])
        count = end[held] - low
        which = np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)
        self.keys = np.repeat(np.flatnonzero(place >= 0) + 1, count) * self.span + at[which]

    def of_doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, position, side="right") - 1

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.span + position
        at = np.searchsorted(self.keys, key)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == key[ok]
        return ok

    def _starts(self, windows: Windows, order: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows ``rows``: each posting of the rarest term, as (row, start of the window)."""
        offset = order[rows, 0]
        term = windows.words[rows, offset]
        low, high = self.first[term], self.first[term + 1]
        n = high - low
        row = np.repeat(np.arange(len(rows)), n)
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        position = self.keys[which] - np.repeat(term * self.span, n)
        return rows[row], position - offset[row]

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, start) of exact occurrences, and (three terms, document) of proximity matches."""
        count = np.append(self.first[1:] - self.first[:-1], 0)
        count[0] = np.iinfo(np.int64).max  # padding comes last
        order = np.argsort(count[windows.words], axis=1, kind="stable")
        exact = []
        alive = np.flatnonzero((count[windows.words] > 0).all(axis=1))
        # pieces of windows whose rarest terms have a bounded number of postings in all
        load = np.cumsum(count[windows.words[alive, order[alive, 0]]]) if len(alive) else np.zeros(0)
        for piece in np.split(alive, np.flatnonzero(np.diff(load // (1 << 20))) + 1) if len(alive) else []:
            r, s = self._starts(windows, order, piece)
            for k in range(1, WINDOW):
                used = k < windows.size[r]
                at = order[r, k]
                good = ~used | self.has(np.where(used, windows.words[r, at], 0), s + at)
                r, s = r[good], s[good]
            exact.append((r, s))
        return (*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*exact) if exact else ((), ()))), *self.near(windows.triples))

    def near(self, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(three terms, document), each pair once, where the second and third term stand within SLOP of the first."""
        count = self.first[1:] - self.first[:-1]
        alive = np.flatnonzero((count[triples] > 0).all(axis=1))
        load = np.cumsum(count[triples[alive, 0]])
        found = [np.zeros((0, 2), np.int64)]
        for piece in np.split(alive, np.flatnonzero(np.diff(load // (1 << 20))) + 1) if len(alive) else []:
            low = self.first[triples[piece, 0]]
            n = count[triples[piece, 0]]
            row = np.repeat(piece, n)
            which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            position = self.keys[which] - triples[row, 0] * self.span
            doc = self.of_doc(position)
            for k in (1, 2):
                base = triples[row, k] * self.span
                begin = np.maximum(position - SLOP, self.start[doc])
                end = np.minimum(position + SLOP, self.start[doc] + self.n_words[doc] - 1)
                at = np.searchsorted(self.keys, base + begin)
                good = at < len(self.keys)
                good[good] = self.keys[at[good]] <= (base + end)[good]
                row, position, doc = row[good], position[good], doc[good]
            found.append(np.unique(np.stack([row, doc], axis=1), axis=0))
        row, doc = np.concatenate(found).T
        return row, doc


def search_shard(windows: Windows, shard: Shard) -> dict[str, list]:
    """Per document: its number of words, ranges of hit words, items with exact and with proximity matches."""
    row, start, near_row, near_doc = shard.search(windows)
    empty = lambda: [[] for _ in shard.n_words]
    out = {"n_words": shard.n_words.tolist(), "ranges": empty(), "items": empty(), "near": empty()}

    def items(rows, docs, name, owner):
        pairs = np.unique(np.stack([docs, rows], axis=1), axis=0)
        low, high = np.searchsorted(owner[:, 0], pairs[:, 1]), np.searchsorted(owner[:, 0], pairs[:, 1], side="right")
        for d, a, b in zip(pairs[:, 0].tolist(), low.tolist(), high.tolist()):
            out[name][d] += [windows.names[k] for k in owner[a:b, 1].tolist()]

    if len(row):
        docs = shard.of_doc(start)
        items(row, docs, "items", windows.owner)
        begin = start - shard.start[docs]
        by = np.lexsort((begin, docs))
        for d, a, n in zip(docs[by].tolist(), begin[by].tolist(), windows.size[row[by]].tolist()):
            ranges = out["ranges"][d]
            if ranges and ranges[-1][1] >= a:
                ranges[-1][1] = max(ranges[-1][1], a + n)
            else:
                ranges.append([a, a + n])
    if len(near_row):
        items(near_row, near_doc, "near", windows.triple_owner)
    return out


def build_index(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The stored index: a row for each shard with its documents' ``keep`` columns (c0, c1, ..), their numbers of words, and its postings."""
    row = T.StructType([T.StructField(f"c{i}", df.schema[k].dataType) for i, k in enumerate(keep)])
    kind = T.StructType([
        T.StructField("shard", T.StringType()), T.StructField("docs", T.ArrayType(row)), T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.StringType()), T.StructField("ends", T.BinaryType()), T.StructField("differences", T.BinaryType())])
    given = df.select(*[F.col(quoted(k)).alias(f"c{i}") for i, k in enumerate(keep)], F.col(quoted(text)).alias("text"))

    def run(batches):
        kinds = arrow_schema(kind)
        of_row = kinds.field("docs").type.value_type
        for i, block in enumerate(blocks(batches, "text", SHARD_BYTES)):
            n_words, terms, ends, differences = postings(block.column("text").to_pylist())
            columns = [block.column(f.name).cast(f.type) for f in of_row]
            docs = pa.StructArray.from_arrays(columns, fields=list(of_row)) if columns else pa.array([{}] * len(n_words), of_row)
            whole = pa.array([0, len(n_words)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{TaskContext.get().partitionId()}-{i}"]), pa.ListArray.from_arrays(whole, docs).cast(kinds.field("docs").type),
                pa.array([n_words], kinds.field("n_words").type), pa.array([terms]), pa.array([ends], pa.binary()), pa.array([differences], pa.binary())], schema=kinds)
        pa.default_memory_pool().release_unused()

    path = new_path(df.sparkSession, "index")
    # rows are large, so that sizes are looked at after each one and a reader holds few at once
    limits = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "compression": "zstd"}
    given.mapInArrow(run, kind).write.options(**limits).parquet(path)
    return df.sparkSession.read.schema(kind).parquet(path)


def _groups(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in groups of at most ``limit`` bytes or of one item; sizes are summed before anything is collected, and one group is held at a time."""
    items = benchmark.where(F.col(quoted(text)).isNotNull() & F.col(quoted(item)).isNotNull()).select(F.col(quoted(item)).cast("string").alias("name"), F.col(quoted(text)).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, -(-2 * total // limit)) if total > limit else 1
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k)
        held, size = [], 0
        for r in part.toLocalIterator():
            n = len(r["text"].encode()) + 64
            if held and size + n > limit:
                yield held
                held, size = [], 0
            held.append((r["name"], r["text"]))
            size += n
        if held:
            yield held


def occurrences(index: DataFrame, terms: set[str]) -> dict[str, int]:
    """How often each term occurs in all documents; rows come back for no more than the terms."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        own, total = sent.value, Counter()
        for batch in batches:
            for held, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist()):
                n = np.diff(np.frombuffer(ends, "<i4"), prepend=0).tolist()
                total.update({w: k for w, k in zip(held.split("\n"), n) if w in own})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    counted = index.select("terms", "ends").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = {r["term"]: r["n"] for r in counted.toLocalIterator()}
    sent.unpersist()
    return out


def search(index: DataFrame, group, *, only_found: bool) -> DataFrame:
    """shard, place, doc and ``match`` of the index's documents for a group that has been sent: all, or only those with a match."""
    kind = T.StructType([T.StructField("shard", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("doc", index.schema["docs"].dataType.elementType), T.StructField("match", T.StructType.fromDDL(MATCH))])

    def run(batches):
        windows, kinds = Windows(*group.value), arrow_schema(kind)
        names = [f.name for f in kinds.field("match").type]
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in ("shard", "n_words", "terms", "ends", "differences")}
                shard = Shard(*(one[c].as_py() for c in ("n_words", "terms", "ends", "differences")), windows.terms)
                found = search_shard(windows, shard)
                matches = [dict(zip(names, x)) for x in zip(*(found[k] for k in names))]
                places = [k for k, m in enumerate(matches) if m["ranges"] or m["near"]] if only_found else range(len(matches))
                take = pa.array(places, pa.int32())
                docs = batch.column("docs")[i].values.take(take)
                yield pa.RecordBatch.from_arrays([pa.array([one["shard"].as_py()] * len(take), pa.string()), take, docs, pa.array([matches[k] for k in places], kinds.field("match").type)], schema=kinds)
        pa.default_memory_pool().release_unused()

    return index.mapInArrow(run, kind)


def find_matches(df: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``keep`` and ``match``: struct of n_words, ranges (array of [begin, end)), items, near (item names). One row per row."""
    spark = df.sparkSession
    index = build_index(df, keep, text)
    own = [F.col(f"doc.c{i}").alias(k) for i, k in enumerate(keep)]
    groups = _groups(benchmark, item, item_text, query_bytes)
    parts, group = [], next(groups, [])
    while True:
        counted = occurrences(index, {w for _, t in group for w in words_of(t)}) if group else {}
        sent = spark.sparkContext.broadcast((group, counted))
        group = next(groups, None)
        if group is None and not parts:
            return search(index, sent, only_found=False).select(*own, "match")
        parts.append(materialize(search(index, sent, only_found=True).select("shard", "place", "match"), "matches"))
        sent.destroy()
        if group is None:
            break
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    # a document has a row for each group at most
    each = lambda k: F.flatten(F.collect_list(f"match.{k}")).alias(k)
    found = found.groupBy("shard", "place").agg(each("ranges"), each("items"), each("near"))
    docs = index.select("shard", F.posexplode(F.arrays_zip("docs", "n_words")).alias("place", "d")).select("shard", "place", F.col("d.docs").alias("doc"), F.col("d.n_words").cast("bigint").alias("n_words"))
    rows = docs.join(found, ["shard", "place"], "left")
    none = F.array()
    match = F.struct("n_words", F.coalesce("ranges", none.cast("array<array<bigint>>")).alias("ranges"), *[F.coalesce(k, none.cast("array<string>")).alias(k) for k in ("items", "near")])
    return rows.select(*own, match.alias("match"))


def contamination(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    found = find_matches(df, benchmark, keep=[id_col], text=text, **options).toDF(id_col, "match")
    spans = F.array_sort("match.ranges")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    # the union of ranges, which passes of several groups may have overlap
    hit = F.aggregate(spans, start, lambda acc, r: F.struct(F.greatest(acc["end"], r[1]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(acc["end"], r[0]))).alias("n")), lambda acc: acc["n"])
    items = F.array_sort(F.array_distinct("match.items"))
    return found.select(
        quoted(id_col), F.col("match.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.size(F.array_distinct("match.near")).cast("long").alias("n_near_items"),
    )


def without_matches(df: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows whose text holds no window of an item; columns and their names stay.

    Matches depend on the text alone, so that the index keeps the texts' digests and rows are told by them. A bitmap of the
    digests with a hit tells which rows have to meet them; the others stay where they are. Null texts stay.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    own = names[df.columns.index(text)]
    rows = rows.withColumn("digest", F.unhex(F.md5(own)))
    found = find_matches(rows, benchmark, keep=["digest"], text=own, **options)
    hit = materialize(found.where(F.size("match.ranges") > 0).select("digest").distinct(), "hits")
    without, may = parted(rows, "digest", hit)
    return without.unionByName(may.join(hit.hint("merge"), "digest", "left_anti")).select(*names).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
