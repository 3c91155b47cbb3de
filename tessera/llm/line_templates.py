"""Line dedup by a tree of log templates: lines whose template recurs across documents are dropped.

A line with a word is parsed down a tree of fixed depth: by its token count, then by
its first ``LEAD`` tokens; a token that holds a digit is a variable field. A leaf's
lines make templates in two ways:

* exact: the tokens themselves, digit fields generalised;
* generalised: a leaf's exact templates, each weighing the groups of copies that hold
  it, are clusters that split until a template fits. A cluster's template has at each
  position the most frequent token if at least half of its weight has it there, else a
  variable field (if that leaves no variable field, what all lines hold is constant); it fits when at least ``MIN_CONSTANT`` per cent of its positions, and
  four, are constant. Lines whose tokens agree with all constants are of it and leave
  the cluster. The others split by the tokens they hold of the cluster's major ones:
  not held by all, of a weight of at least ``min_docs`` and half of the largest such
  weight. So a leaf has any number of templates. Each round is a few aggregations over
  the lines that are left; no task holds a cluster.

A template recurs when documents of at least ``min_docs`` different groups of copies
hold it, however many copies each group has. So a header, footer or notice recurs, of
one line or many, while the body of a document that was copied a thousand times does
not: copies are left whole for near-duplicate removal.

Copies are documents whose lines have the same exact templates, and those linked by
near copies: each text's 5-word shingles, digit fields masked, make a sketch of
``BINS`` least hashes, and two texts are near copies if ``NEAR`` per cent of the bins
that either fills agree. Sketches are compared with the leader of each band of
``ROWS`` bins they share, so a group of thousands costs a few pairs a member.

Everything is counted over all lines in aggregations that combine before they
shuffle. Templates found to recur are broadcast in blocks of ``BLOCK`` hashes, each
block one narrow pass over the documents.

Documents are told apart by id (all null ids are one document); a template counts once
a document. Null texts stay null and hold no line. Lines without a word are kept. All
rows and columns come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.jaccard_join import small
from tessera.llm.text import distinct, materialize, shingle_hashes, small_slices, word_hashes

LEAD = 3
MIN_DOCS = 10
MIN_CONSTANT = 60
#: Constant positions that a generalised template has at least.
LEAST = 4
BLOCK = 1 << 21
#: Bins of a sketch (a power of two), bins of a band, per cent of bins that near copies agree in.
BINS, ROWS, NEAR = 64, 4, 80
_DIGITS = b"0123456789"
_FIELD = b"<*>"
_MASK = (1 << 64) - 1


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


FIELD = _hash(_FIELD)


def masked(line: bytes) -> list[bytes]:
    """A line's tokens, those that hold a digit as variable fields."""
    tokens = line.split()
    if len(line.translate(None, _DIGITS)) != len(line):
        tokens = [t if len(t.translate(None, _DIGITS)) == len(t) else _FIELD for t in tokens]
    return tokens


class Line:
    """A line with a word: its number, masked tokens, the hashes of its leaf and exact template."""

    __slots__ = ("number", "tokens", "leaf", "exact")

    def __init__(self, number: int, tokens: list[bytes]):
        self.number, self.tokens = number, tokens
        self.leaf = _hash(b"%d " % len(tokens) + b" ".join(tokens[:LEAD]))
        self.exact = _hash(b" ".join(tokens))

    def hashes(self) -> list[int]:
        return list(map(_hash, self.tokens))


def parse(raw: bytes) -> list[Line]:
    return [Line(i, tokens) for i, line in enumerate(raw.split(b"\n")) if (tokens := masked(line))]


def whole(lines: list[Line]) -> int:
    """A hash of the exact templates of a text, in order."""
    return _hash(b" ".join([b"%d" % x.exact for x in lines]))


def sketch(lines: list[Line]) -> np.ndarray:
    """The least shingle hash of a text in each bin, 32 bits of it; 0 in bins without one."""
    s = distinct(shingle_hashes(word_hashes(b" ".join([t for x in lines for t in x.tokens]).lower())))
    bins = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out = np.zeros(BINS, dtype=np.uint32)
    out[bins[first]] = (s[first] >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
    return out


def _raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _member(of: np.ndarray, values: list[int]) -> np.ndarray:
    """Which values are in a sorted array."""
    v = np.array(values, dtype=np.int64)
    if not len(of) or not len(v):
        return np.zeros(len(v), dtype=bool)
    return of[np.minimum(np.searchsorted(of, v), len(of) - 1)] == v


def _lines(docs: DataFrame, leaves=None) -> DataFrame:
    """leaf (null if too short for a variable field), exact, doc, whole of each line, and whole and sketch of each text, once a task;
    with ``leaves`` (a broadcast sorted array) exact, leaf, tokens of their exact templates, once a task."""
    names = ["leaf", "exact", "doc", "whole", "sketch"] if leaves is None else ["exact", "leaf", "tokens"]
    kinds = [pa.int64()] * 4 + [pa.binary()] if leaves is None else [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for b in small_slices(batch, 4 << 20):
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    lines = parse(_raw(text))
                    if leaves is None:
                        w = whole(lines)
                        rows += [(x.leaf if len(x.tokens) > LEAST else None, x.exact, doc, w, None) for x in lines]
                        if lines and w not in seen:
                            seen.add(w)
                            rows.append((None, None, None, w, sketch(lines).tobytes()))
                        continue
                    lines = [x for x in lines if len(x.tokens) > LEAST and x.exact not in seen]
                    for x, use in zip(lines, _member(leaves.value, [x.leaf for x in lines])):
                        if use and x.exact not in seen:
                            seen.add(x.exact)
                            rows.append((x.exact, x.leaf, x.hashes()))
                cols = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return docs.mapInArrow(run, "leaf bigint, exact bigint, doc bigint, whole bigint, sketch binary" if leaves is None else "exact bigint, leaf bigint, tokens array<bigint>")


def copies(drawn: DataFrame) -> DataFrame:
    """(node, label): the group of near copies of each different text that has one, from (node, sketch) rows."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys = [], []
            for node, drawn in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in range(0, 4 * BINS, 4 * ROWS):
                    if any(part := drawn[k:k + 4 * ROWS]):
                        nodes.append(node)
                        keys.append(_hash(b"%d " % k + part))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], names=["key", "node"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint32).reshape(-1, BINS) for k in (2, 3))
            near = 100 * ((x == y) & (x != 0)).sum(axis=1) >= NEAR * ((x != 0) | (y != 0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near)), b.column(1).filter(pa.array(near))], names=["a", "b"])

    drawn = materialize(drawn.groupBy("node").agg(F.min("sketch").alias("sketch")), "sketches")
    keys = materialize(drawn.mapInArrow(band, "key bigint, node bigint"), "bands")
    leads = materialize(keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("key", "a"), "leaders")
    pairs = materialize(keys.join(small(leads), "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "pairs")
    mine = drawn.join(small(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    both = pairs.join(mine, "a").join(drawn.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return components(materialize(both.select("a", "b", "x", "y").mapInArrow(agree, "a bigint, b bigint"), "near"))


def _recurring(held: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Keys of (key, copies) rows that at least ``min_docs`` groups of copies hold."""
    return held.select(key, "copies").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_groups")).where(f"n_groups >= {min_docs}").select(key)


def _blocks(df: DataFrame, key: str, n: int) -> Iterator:
    """The distinct keys of a table, sorted, in n broadcast blocks."""
    for k in range(n):
        part = df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k).select(key).toArrow().column(0).to_numpy()
        yield df.sparkSession.sparkContext.broadcast(distinct(part.astype(np.int64)))


def _count_blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _held_cells(cells: DataFrame) -> DataFrame:
    """Marked for broadcast if (key, template) rows are proven small by their tokens."""
    n = cells.agg(F.sum(F.size("template"))).first()[0] or 0
    return F.broadcast(cells) if n <= 1 << 20 else cells


def _cells(items: DataFrame) -> DataFrame:
    return items.select("key", "exact", "weight", F.posexplode("tokens").alias("pos", "token")).where(F.col("token") != F.lit(FIELD))


def generalise(items: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Of clusters (key, exact, weight, tokens): the templates that fit (key, template), nulls for variable fields, and the major tokens (key, pos, token)."""
    sizes = items.groupBy("key").agg(F.sum("weight").alias("total"), F.max(F.size("tokens")).alias("length"))
    counts = materialize(_cells(items).groupBy("key", "pos", "token").agg(F.sum("weight").alias("n")), "tokens")
    top = counts.groupBy("key", "pos").agg(F.max(F.struct("n", "token")).alias("top")).join(sizes, "key")
    # a line's tokens bound the positions of a cluster
    half, all_ = 2 * F.col("top.n") >= F.col("total"), F.col("top.n") == F.col("total")
    by_key = top.groupBy("key").agg(F.max("length").alias("length"), F.max("total").alias("total"), F.max(F.when(~all_, F.col("top.n"))).alias("most"),
                                    F.collect_list(F.when(half, F.struct("pos", "top.token", all_.alias("everywhere")))).alias("constants"))
    # constant throughout is an exact template: then what all lines hold is constant
    shared = F.when(F.size("constants") == F.col("length"), F.filter("constants", lambda c: c["everywhere"])).otherwise(F.col("constants"))
    by_key = materialize(by_key.withColumn("constants", F.transform(shared, lambda c: F.struct(c["pos"], c["token"]))), "clusters")
    n_constant = F.size("constants")
    fit = by_key.where((n_constant * 100 >= F.col("length") * MIN_CONSTANT) & (n_constant >= LEAST) & (n_constant < F.col("length")))
    at = F.map_from_entries("constants")
    made = fit.select("key", F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.try_element_at(at, i)).alias("template"))
    split = by_key.where(f"most >= {min_docs}").select("key", "total", "most")
    major = counts.join(small(split), "key").where((F.col("n") < F.col("total")) & (F.col("n") >= min_docs) & (2 * F.col("n") >= F.col("most")))
    return made, major.select("key", "pos", "token")


def _matches() -> F.Column:
    return F.forall(F.zip_with("template", "tokens", lambda c, t: c.isNull() | (c == t)), lambda ok: ok)


def clusters(items: DataFrame, min_docs: int) -> DataFrame:
    """(exact, leaf, template): the generalised template of each exact one that has one, from (exact, leaf, weight, tokens) rows."""
    found = []
    items = items.withColumn("key", F.col("leaf"))
    while not items.isEmpty():
        made, major = (materialize(x, "templates") for x in generalise(items, min_docs))
        told = materialize(items.join(_held_cells(made), "key", "left").withColumn("fits", F.col("template").isNotNull() & F.coalesce(_matches(), F.lit(False))), "told")
        found.append(told.where("fits").select("exact", "leaf", "template"))
        rest = told.where("NOT fits").drop("fits", "template")
        parted = _cells(rest).join(small(major), ["key", "pos", "token"]).groupBy("exact").agg(F.bit_xor(F.xxhash64("pos", "token")).alias("part"))
        again = rest.join(small(major.select("key").distinct()), "key", "left_semi").join(small(materialize(parted, "parts")), "exact", "left")
        again = materialize(again.withColumn("key", F.xxhash64("key", F.coalesce("part", F.lit(0)))).drop("part"), "clusters")
        # lighter clusters can't recur, and one exact template is its own
        live = again.groupBy("key").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).where(f"total >= {min_docs} AND n > 1").select("key")
        items = materialize(again.join(small(materialize(live, "keys")), "key", "left_semi"), "clusters")
    out = items.select("exact", "leaf", F.col("tokens").alias("template"))
    for x in found:
        out = out.unionByName(x)
    return out


def recurring_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """From (doc, text) rows: exact templates that recur, and generalised templates that recur with their leaves."""
    seen = materialize(_lines(docs), "lines")
    groups = small(materialize(copies(seen.where("sketch IS NOT NULL").select(F.col("whole").alias("node"), "sketch")), "copies"))
    lines = seen.where("sketch IS NULL").select("leaf", "exact", "doc", "whole")
    of = lines.groupBy("doc").agg(F.min("whole").alias("node")).join(groups, "node", "left").select("doc", F.coalesce("label", "node").alias("copies"))
    held = materialize(lines.join(small(materialize(of, "groups")), "doc").select("leaf", "exact", "copies").distinct(), "held")
    weights = materialize(held.groupBy("exact").agg(F.min("leaf").alias("leaf"), F.count(F.lit(1)).alias("weight")), "weights")
    exact = materialize(weights.where(f"weight >= {min_docs}").select("exact"), "exact-templates")
    # leaves that recur, with a line that doesn't go by its exact template
    varied = weights.where("leaf IS NOT NULL").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least")).where(f"n > 1 AND least < {min_docs}").select("leaf")
    leaves = materialize(_recurring(held.join(small(materialize(varied, "varied")), "leaf", "left_semi"), "leaf", min_docs), "leaves")
    made = docs.sparkSession.createDataFrame([], "leaf bigint, template array<bigint>")
    n_leaves = leaves.count()
    for block in _blocks(leaves, "leaf", _count_blocks(n_leaves, BLOCK)) if n_leaves else ():
        tokens = materialize(_lines(docs, block), "leaf-lines").groupBy("exact").agg(F.min("leaf").alias("leaf"), F.min("tokens").alias("tokens"))
        of = materialize(clusters(materialize(tokens.join(weights.select("exact", "weight"), "exact"), "items"), min_docs), "general")
        named = of.select("exact", F.xxhash64("leaf", "template").alias("name"))
        found = _recurring(held.join(small(named), "exact"), "name", min_docs)
        made = made.unionByName(of.select("leaf", "template").distinct().join(found, F.xxhash64("leaf", "template") == F.col("name"), "left_semi"))
    return exact, materialize(made, "general-templates")


def drop_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS,
               n_lines_col: str | None = None, n_dropped_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, the text without the lines of recurring templates; with counts if columns are named."""
    narrow = docs.select(F.coalesce(F.xxhash64(F.col(f"`{id_col}`")), F.lit(0)).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    exact, general = recurring_templates(narrow, min_docs)
    n = max(_count_blocks(exact.count(), BLOCK), _count_blocks(general.count(), BLOCK >> 5))
    names = [f"k{i}" for i in range(len(docs.columns))]
    at, spark = docs.columns.index(text_col), docs.sparkSession
    out = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string")).withColumn("drop", F.array().cast("array<int>"))

    for k, same in enumerate(_blocks(exact, "exact", n)):  # every block but the last notes lines to drop, the last drops them
        rows = general.where(F.pmod(F.xxhash64("leaf"), F.lit(n)) == k).collect()
        by_leaf: dict[int, list] = {}
        for r in rows:
            by_leaf.setdefault(r.leaf, []).append([(i, c) for i, c in enumerate(r.template) if c is not None])
        like = spark.sparkContext.broadcast(by_leaf)
        final = k == n - 1

        def run(batches: Iterator[pa.RecordBatch], same=same, like=like, final=final) -> Iterator[pa.RecordBatch]:
            templates = like.value

            def general_hit(x: Line) -> bool:
                if not (of := templates.get(x.leaf)):
                    return False
                own = x.hashes()
                return any(all(own[i] == c for i, c in t) for t in of)

            for whole in batches:
                for b in small_slices(whole, 4 << 20):
                    texts, drops, counts = b.column(at).to_pylist(), b.column(len(names)).to_pylist(), []
                    for i, text in enumerate(texts):
                        lines = parse(_raw(text))
                        hit = _member(same.value, [x.exact for x in lines])
                        found = {x.number for x, h in zip(lines, hit) if h or templates and general_hit(x)}
                        drops[i] = sorted(found.union(drops[i]))
                        counts.append(len(lines))
                        if final and drops[i]:
                            gone = set(drops[i])
                            texts[i] = "\n".join([x for j, x in enumerate(text.split("\n")) if j not in gone])
                    cols = [*b.columns[:-1], pa.array(drops, pa.list_(pa.int32()))]
                    if final:
                        cols[at] = pa.array(texts, pa.string())
                        cols[-1:] = [pa.array(counts, pa.int64()), pa.array(list(map(len, drops)), pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, *(["n", "gone"] if final else ["drop"])])

        spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields[:-1])
        out = out.mapInArrow(run, spec + (", n bigint, gone bigint" if final else ", drop array<int>"))
    more = [c for c in (n_lines_col, n_dropped_col) if c]
    return out.select(*[F.col(k).cast(f.dataType).alias(f.name) for k, f in zip(names, docs.schema) if f.name not in more],
                      *[F.col(x).alias(c) for x, c in (("n", n_lines_col), ("gone", n_dropped_col)) if c])
