"""Operator 6: SimHash near-duplicates by a binary trie self-join.

Fingerprints: every word shingle's XXH64 votes on 64 bits. Join: the trie of distinct fingerprints is traversed against
itself, node pair by node pair, adding up the differing bits on the way down and leaving a pair once they exceed the
budget. For a budget of d the 64 bits are cut into d + 2 blocks; two fingerprints within the budget agree in at least
two of them, so one trie is built for each choice of two blocks, which stand first: there only pairs of equal nodes
survive, which deals the tries' subtrees to tasks by key (pigeonhole), and the rest is traversed in numpy, level by
level, in bounded pieces. A subtree emits a spanning forest of its links, not all pairs. Links are then contracted to
components: each round every fingerprint takes the least neighbour (by a mixed order) as its name, until no link is
left. No fingerprint, link or component is collected.

Null and empty texts have no words, hence fingerprint zero, linked like any other. Repeated rows give repeated rows.
Null ids are never the least id; a component of null ids only has a null component_id; ties between rows of one id go to
the least hash of the text. Empty tables give no rows; a very long text is a block of its own. Ids may be of any ordered
type. Other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower, discard, map_texts, materialize, quoted, read

SHINGLE = 3
BUDGET = 2
SEED = 42
#: Hashes that are added up at a time.
HASHES = 1 << 17
#: Node pairs that the traversal holds at a time.
FRONTIER = 1 << 20


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the space-joined shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    import xxhash

    words = ascii_lower(text).encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return np.fromiter((digest(x, SEED) for x in runs), np.uint64, len(words) - shingle + 1)


def fingerprint(hashed: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    if not len(hashed):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashed), HASHES):
        part = hashed[i : i + HASHES].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * v > len(hashed) else "0" for v in votes.tolist()), 2)


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def block(texts):
        out = []
        for t in texts:
            f = fingerprint(hashes(t, shingle))
            out.append(f - (1 << 64) if f >> 63 else f)
        return {"fp": out}

    return map_texts(df, text, block, "fp long", keep)


def _layouts(budget: int) -> list[list[int]]:
    """For each trie the order of bits (0 is the lowest), from its root down, and how many of them must agree."""
    edges = [64 * i // (budget + 2) for i in range(budget + 3)]
    parts = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in itertools.combinations(range(budget + 2), 2):
        rest = [i for i in range(budget + 2) if i not in chosen]
        out.append(([b for i in chosen for b in reversed(parts[i])], [b for i in rest for b in reversed(parts[i])]))
    return out


def _gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((values >> np.uint64(b)) & np.uint64(1))
    return out


class Forest:
    """Least member of each one's group; links only ever join groups."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def traverse(values: np.ndarray, depth: int, roots: np.ndarray, budget: int, forest: Forest) -> None:
    """Link the members of each root that differ in at most ``budget`` of ``depth`` bits.

    ``values`` are sorted inside each root; roots are the places where they begin, and the end of the last. A node is a
    range of places; a node pair goes down to the pairs of its children, with one more differing bit for unlike ones.
    """
    ends = roots[1:]
    starts = roots[:-1]
    big = ends - starts > 1
    zero = np.zeros(int(big.sum()), np.int64)
    stack = [(depth - 1, starts[big], ends[big], starts[big], ends[big], zero)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, s1, e1, s2, e2, off = stack.pop()
        if len(s1) > FRONTIER:
            half = len(s1) // 2
            stack += [(bit, *[x[half:] for x in (s1, e1, s2, e2, off)]), (bit, *[x[:half] for x in (s1, e1, s2, e2, off)])]
            continue
        single = (e1 - s1 == 1) & (e2 - s2 == 1)
        if single.any():  # two leaves below: their remaining bits at once
            a, b = s1[single], s2[single]
            far = np.bitwise_count(values[a] ^ values[b])
            forest.link(a[far <= budget], b[far <= budget])
            s1, e1, s2, e2, off = (x[~single] for x in (s1, e1, s2, e2, off))
        if bit < 0 or not len(s1):
            continue
        if bit not in ones:
            ones[bit] = np.append(0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))
        count = ones[bit]
        m1, m2 = e1 - (count[e1] - count[s1]), e2 - (count[e2] - count[s2])
        same = s1 == s2
        unlike = ~same
        parts = (
            (s1, m1, s2, m2, off, None),
            (m1, e1, m2, e2, off, None),
            (s1, m1, m2, e2, off + 1, None),
            (m1, e1, s2, m2, off + 1, unlike),
        )
        below = []
        for a, b, c, d, n, only in parts:
            live = (b > a) & (d > c) & (n <= budget) & ((a != c) | (b - a > 1))
            if only is not None:
                live &= only
            below.append([x[live] for x in (a, b, c, d, n)])
        stack.append((bit - 1, *[np.concatenate(x) for x in zip(*below)]))


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within the budget; a forest for each subtree."""
    layouts = _layouts(budget)

    def keyed(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for trie, (top, rest) in enumerate(layouts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), trie, np.int32)), pa.array(_gather(fp, top).view(np.int64)), pa.array(_gather(fp, rest).view(np.int64)), batch.column(0)],
                    names=["trie", "top", "rest", "fp"],
                )

    def joined(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(i).to_numpy() for i in range(4)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if held is None or not len(held[0]):
                continue
            trie, top, rest, fp = held
            edge = np.flatnonzero(np.append(True, (trie[1:] != trie[:-1]) | (top[1:] != top[:-1])))
            # the last subtree may go on in the next batch
            done = len(fp) if batch is None else int(edge[-1])
            held = None if batch is None else [x[done:] for x in held]
            if not done:
                continue
            forest = Forest(done)
            traverse(rest[:done].view(np.uint64), max(len(rest_bits) for _, rest_bits in layouts), np.append(edge[edge < done], done), budget, forest)
            child = np.flatnonzero(forest.label != np.arange(done))
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[forest.label[child]])], names=["a", "b"])

    tries = distinct.select("fp").mapInArrow(keyed, "trie int, top long, rest long, fp long")
    dealt = tries.repartition("trie", "top").sortWithinPartitions("trie", "top", "rest")
    return dealt.mapInArrow(joined, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint with a link: fingerprints of a component share their root.

    Each round a vertex is renamed to the least of itself and its neighbours in an order that a hash of round and
    vertex mixes, so that even a long chain shrinks by a constant factor; edges between equal names go.
    """
    edges = materialize(edges.where("a != b"), "links")
    names, step, old = None, 0, []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        order = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        to = materialize(least.select(F.col("a").alias("v"), F.least("m", order("a"))["v"].alias("to")), "names")
        named = edges.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").where("x != y")
        old.append(edges)
        if names is None:
            names = to.toDF("fp", "root")
        else:
            old += [names, to]
            names = materialize(names.join(to.toDF("root", "to"), "root", "left").select("fp", F.coalesce("to", "root").alias("root")), "roots")
        edges = materialize(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        while old:  # what this round has read is not needed any more
            discard(old.pop())
        step += 1
    if names is None:
        return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return names


def simhash_groups(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per row: id, fingerprint (16 hex digits), component_id."""
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text"))
    prints = materialize(fingerprints(rows, ["id"], "text", shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    distinct = materialize(distinct, "distinct")
    rooted = distinct.join(components(links(distinct, budget)), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    labels = materialize(labels, "labels")
    return prints.join(labels, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The rows whose id is the least of their group, one row a group (the least text hash of equal ids); columns stay, whatever their names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    own_id, own_text = names[df.columns.index(id_col)], names[df.columns.index(text)]
    # null ids come last; equal rows share a key and are told apart only after they have met. Rows meet by columns without
    # nulls, so that the join and the last step share a partitioning
    order = {"none": F.col(own_id).isNull(), "id": F.col(own_id), "hash": F.xxhash64(own_text)}
    prints = materialize(fingerprints(rows.withColumns(order).select(*order, own_text), list(order), own_text, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(F.struct(*order)).alias("least")), "distinct")
    rooted = distinct.join(components(links(distinct, budget)), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    first = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.none", plain(F.col("least.id")).alias("name"), "least.hash")
    key = ["none", "name", "hash"]
    keyed = rows.withColumns({"none": order["none"], "name": plain(F.col(own_id)), "hash": order["hash"]})
    return keyed.join(first, key, "left_semi").dropDuplicates(key).select(*names).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))
