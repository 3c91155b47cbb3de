"""N-gram Jaccard self-join with set-relation skipping, and the components of its links.

A document's set is its distinct word n-grams. Two sets link when
100 * |intersection| >= ``threshold`` * |union|. Documents with equal sets are one
node from the start; a node is named by the 64-bit hash of its set.

Index. Every set is put into one global order: frequent n-grams last, the others by
hash. Sets that link share an n-gram among the first n - ceil(t * n) + 1 of both, so
only these are indexed, each with its position and the set's size. (Frequent are at
most ``MAX_FREQUENT`` n-grams: those counted often over all documents in chunks,
then those whose lists in a first index are long, so that lists stay short however
many documents there are. The order decides the cost, never the result.)

Index-level skipping. In a list, a set at position i of n shares at most n - i
n-grams with a set it meets there first. Lists are sorted by size and position, so
blocks of partners with a size or position that can't reach the overlap a link
needs are skipped unseen.

Answer-level skipping. First each list's leader, the set with the least position,
has its answers computed: it is verified against the list's members. A set linked to
a leader takes over the leader's component as its answer; what remains to be
searched for it is the difference, the partners in its lists that lie in other
components. These pairs pass an upper bound on 16-bit hashes, then the exact count.
So a group of thousands of near copies costs a few pairs a member.

Verification groups (centre, member) pairs by centre; the members of a centre are
spread over several tasks by their number, and each task streams them past the
centre's set. Every pair is decided by its exact count; no list, group or number of
partners is capped.

Rows with a null id or an empty set link with nothing. Rows with the same id are one
document for the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.text import SHINGLE_WORDS, distinct, materialize, shingle_set, small_slices

THRESHOLD = 80
MAX_FREQUENT = 1 << 20
#: An n-gram is frequent if it is in at least one in so many sets, or if its list has more sets than LONG_LIST.
FREQUENT_SHARE = 1000
LONG_LIST = 48
CHUNK = 1 << 21
#: Members of a centre that a task verifies, about.
MEMBERS = 512
#: Rows of ids that may be broadcast: 16 bytes each.
MAX_BROADCAST = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is proven small; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def needed(n: int, t: int) -> int:
    return -(-t * n // 100)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc, node, size, false) of all documents, and (null, n-gram, count, true) of n-grams that recur within a chunk of documents."""

    def frequent(sets: dict[int, np.ndarray]) -> list[np.ndarray]:
        all_ = np.sort(np.concatenate(list(sets.values())))
        edge = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1], [True])))
        count = np.diff(edge)
        use = count >= max(4, len(sets) / FREQUENT_SHARE)
        return [all_[edge[:-1][use]].view(np.int64), count[use]]

    def batch(doc, node, size, gram):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array([gram] * len(doc), pa.bool_())],
                                          names=["doc", "node", "size", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0
        for whole in batches:
            for b in small_slices(whole):
                nodes, sizes = [], []
                for text in b.column(1).to_pylist():
                    s = shingle_set(text, n)
                    k = node_of(s) if len(s) else None
                    nodes.append(k)
                    sizes.append(len(s))
                    if len(s) and k not in sets:
                        sets[k] = s
                        held += len(s)
                yield batch(b.column(0), nodes, sizes, False)
                if held > CHUNK:
                    grams, count = frequent(sets)
                    yield batch(pa.nulls(len(grams), pa.int64()), grams, count, True)
                    sets, held = {}, 0
        if sets:
            grams, count = frequent(sets)
            yield batch(pa.nulls(len(grams), pa.int64()), grams, count, True)

    return docs.mapInArrow(run, "doc bigint, node bigint, size bigint, gram boolean")


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: frequent n-grams last."""
    if not len(frequent):
        return s
    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return np.concatenate((s[~often], s[often]))


def index(docs: DataFrame, frequent, n: int, t: int) -> DataFrame:
    """(gram, node, size, pos): the indexed n-grams of each set, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for whole in batches:
            for b in small_slices(whole):
                grams, nodes, sizes, pos = [], [], [], []
                for text in b.column(0).to_pylist():
                    s = shingle_set(text, n)
                    if not len(s) or (k := node_of(s)) in seen:
                        continue
                    seen.add(k)
                    m = len(s) - needed(len(s), t) + 1
                    grams.append(ordered(s, frequent.value)[:m])
                    nodes.append(np.full(m, k, dtype=np.int64))
                    sizes.append(np.full(m, len(s), dtype=np.int32))
                    pos.append(np.arange(m, dtype=np.int32))
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (nodes, sizes, pos))],
                                                     names=["gram", "node", "size", "pos"])

    return docs.mapInArrow(run, "gram bigint, node bigint, size int, pos int")


def may_link(n1, i1, n2, i2, t: int):
    """Whether sets of n1 and n2 that first meet at positions i1 and i2 can still reach the overlap of a link."""
    reach = np.minimum(n1 - i1, n2 - i2).astype(np.int64) * (100 + t) >= t * (n1.astype(np.int64) + n2)
    return reach & (100 * np.minimum(n1, n2).astype(np.int64) >= t * np.maximum(n1, n2).astype(np.int64))


def lists(postings: DataFrame, t: int) -> DataFrame:
    """The rows of lists with two sets or more, each with its list's leader and whether the two may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told, last = None, False, None  # the running list's leader, whether its own row is out, the row before
        for b in batches:
            if not b.num_rows:
                continue
            g, node, size, pos = (b.column(i).to_numpy() for i in range(4))
            same = np.concatenate(([last is not None and (g[0], node[0]) == last], (g[1:] == g[:-1]) & (node[1:] == node[:-1])))
            last = (g[-1], node[-1])
            g, node, size, pos = g[~same], node[~same], size[~same], pos[~same]
            if not len(g):
                continue
            ghost = int(first is not None)
            if ghost:
                g, node, size, pos = (np.concatenate(([x], y)).astype(y.dtype) for x, y in zip(first, (g, node, size, pos)))
            new = np.concatenate(([True], g[1:] != g[:-1]))
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            follow = lead != np.arange(len(g))
            out = follow.copy()
            out[lead[follow]] = True  # leaders that have a follower here
            if ghost:
                out[0] &= not told
                told = told or bool((lead[1:] == 0).any())
            tail = lead[-1]
            if tail or not ghost:
                told = bool((lead[tail + 1:] == tail).any())
            first = (g[tail], node[tail], size[tail], pos[tail])
            ok = may_link(size, pos, size[lead], pos[lead], t) & follow
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (g, node, size, pos, node[lead], ok)], names=["gram", "node", "size", "pos", "lead", "ok"])

    rows = postings.repartition("gram").sortWithinPartitions("gram", "pos", "size", "node")
    return rows.mapInArrow(run, "gram bigint, node bigint, size int, pos int, lead bigint, ok boolean")


def other_pairs(rows: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of sets that share a list, may link, and lie in different components."""

    def pairs_of(node, size, pos, label) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((pos, size))
        node, size, pos, label = node[order], size[order], pos[order], label[order]
        top = np.searchsorted(size, 100 * size.astype(np.int64) // t, "right")  # block of sizes that may link
        for x in range(len(node) - 1):
            y = slice(x + 1, top[x])
            if y.start >= y.stop:
                continue
            use = (label[y] != label[x]) & may_link(size[x], pos[x], size[y], pos[y], t)
            if use.any():
                yield np.full(int(use.sum()), node[x]), node[y][use]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush(parts):
            if not parts:
                return
            a = np.concatenate([np.minimum(x, y) for x, y in parts])
            b = np.concatenate([np.maximum(x, y) for x, y in parts])
            both = np.unique(np.stack((a, b), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        def search(cols):
            parts, n = [], 0
            cuts = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1], [True])))
            two = cuts[:-1][np.diff(cuts) == 2]  # most lists
            x, y = ([c[i] for c in cols[1:]] for i in (two, two + 1))
            use = (x[3] != y[3]) & may_link(x[1], x[2], y[1], y[2], t)
            yield from flush([(x[0][use], y[0][use])] * bool(use.any()))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 3 or (cols[4][lo:hi] == cols[4][lo]).all():
                    continue
                for p in pairs_of(*(c[lo:hi] for c in cols[1:])):
                    parts.append(p)
                    n += len(p[0])
                    if n > 1 << 18:
                        yield from flush(parts)
                        parts, n = [], 0
            yield from flush(parts)

        for b in batches:  # lists are whole: the last of a batch waits for the next
            if not b.num_rows:
                continue
            held.append([c.to_numpy() for c in b.columns])
            if held[-1][0][-1] == held[0][0][0]:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [[c[cut:] for c in cols]]
            yield from search([c[:cut] for c in cols])
        if held:
            yield from search([np.concatenate(c) for c in zip(*held)])

    found = rows.repartition("gram").sortWithinPartitions("gram").select("gram", "node", "size", "pos", "label").mapInArrow(run, "a bigint, b bigint")
    return found.distinct()


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, t: int, exact: bool = True) -> DataFrame:
    """The pairs whose sets link; without ``exact`` those that an upper bound on 16-bit hashes leaves."""
    many = F.ceil(F.col("members") / MEMBERS)
    sizes = pairs.groupBy(F.col("a").alias("centre")).agg(F.count(F.lit(1)).alias("members")).withColumn("parts", many.cast("int")).drop("members")
    of = pairs.join(sizes, F.col("a") == F.col("centre"))
    rows = of.select("centre", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    own = sizes.select("centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = rows.unionByName(own).join(reps, "node").groupBy("doc").agg(F.collect_list(F.struct("centre", "node", "part")).alias("asked"))
    asked = materialize(asked, "asked")
    texts = docs.join(small(asked), "doc").select("text", "asked")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole, 4 << 20):
                centre, node, part, size, data = [], [], [], [], []
                held = 0
                for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s = shingle_set(text, n)
                    raw = (s if exact else np.sort((s >> np.uint64(20)).astype(np.uint16))).tobytes()
                    for x in asked:
                        if node_of(s) != x["node"]:  # another text of the same id
                            continue
                        for col, v in zip((centre, node, part, size, data), (x["centre"], x["node"], x["part"], len(s), raw)):
                            col.append(v)
                        held += len(raw)
                        if held > 8 << 20:
                            yield rows_of(centre, node, part, size, data)
                            centre, node, part, size, data, held = [], [], [], [], [], 0
                yield rows_of(centre, node, part, size, data)

    def rows_of(centre, node, part, size, data):
        return pa.RecordBatch.from_arrays([pa.array(centre, pa.int64()), pa.array(node, pa.int64()), pa.array(part, pa.int32()), pa.array(size, pa.int32()),
                                           pa.array(data, pa.binary())], names=["centre", "node", "part", "size", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, None
        for b in batches:
            out = ([], [])
            for centre, node, part, data in zip(*(b.column(c).to_pylist() for c in ("centre", "node", "part", "data"))):
                s = np.frombuffer(data, dtype=np.uint64 if exact else np.uint16)
                if (centre, part) != key:  # the centre's own row comes first
                    key, mine = (centre, part), s
                elif node != centre:
                    both = np.sort(np.concatenate((mine, s)))
                    shared = int((both[1:] == both[:-1]).sum())  # of 16-bit hashes: no fewer than the sets share
                    if 100 * shared >= t * (len(mine) + len(s) - shared):
                        out[0].append(centre)
                        out[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    sets = texts.mapInArrow(ship, "centre bigint, node bigint, part int, size int, data binary")
    return (sets.withColumn("member", F.col("centre") != F.col("node")).repartition("centre", "part").sortWithinPartitions("centre", "part", "member")
            .mapInArrow(count, "a bigint, b bigint"))


def links(docs: DataFrame, nodes: DataFrame, frequent, n: int, t: int) -> DataFrame:
    """Links between different sets, enough of them to connect whatever links connect."""
    reps = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"))
    rows = materialize(lists(index(docs.select("text"), frequent, n, t), t), "lists")
    long = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > LONG_LIST).orderBy(F.desc("k"), "gram").limit(MAX_FREQUENT)
    if len(often := long.select("gram").toArrow().column(0).to_numpy()):
        every = distinct(np.concatenate((frequent.value, often.astype(np.int64).view(np.uint64))))
        rows = materialize(lists(index(docs.select("text"), docs.sparkSession.sparkContext.broadcast(every), n, t), t), "lists")
    led = materialize(rows.where("ok").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "led")
    first = materialize(verify(led, reps, docs, n, t), "links")
    label = materialize(components(first), "components")
    own = rows.select("gram", "node", "size", "pos").join(small(label), "node", "left").withColumn("label", F.coalesce("label", "node"))
    done = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(other_pairs(own, t).join(small(done), ["a", "b"], "left_anti"), "pairs")
    near = materialize(verify(rest, reps, docs, n, t, exact=False), "near")
    return first.unionByName(verify(near, reps, docs, n, t))


def join_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: the set's size and the least id reachable by links, itself included."""
    all_docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = materialize(scan(all_docs, n), "sets")
    rows = seen.where("NOT gram").select("doc", "node", "size")
    nodes, docs = rows.where("doc IS NOT NULL"), all_docs.where("doc IS NOT NULL")
    often = (seen.where("gram").groupBy("node").agg(F.sum("size").alias("n")).where(F.col("n") >= max(4, nodes.count() // FREQUENT_SHARE))
             .orderBy(F.desc("n"), "node").limit(MAX_FREQUENT).select("node").toArrow().column(0).to_numpy())
    frequent = all_docs.sparkSession.sparkContext.broadcast(distinct(often.astype(np.int64).view(np.uint64)))

    found = links(docs, nodes, frequent, n, threshold)
    # sets of rows with the same id
    same = nodes.where("node IS NOT NULL").groupBy("doc").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    found = found.unionByName(nodes.join(small(same), "doc").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")))
    label = materialize(components(found), "components")
    labelled = rows.join(small(label), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("doc").alias("least")).where("label IS NOT NULL")
    out = labelled.join(least, "label", "left").withColumn("component", F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc")))
    return out.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
