"""Secret scans that tell live-looking credentials from widely copied examples, by who owns them.

Everything here is DataFrame expressions: regular expressions, windows, joins and grouped
counts, all on the JVM.

Kinds. ``assign`` (a value of 8 or more characters given to a password, secret, token or API
key), ``access`` (an access key id of 16 or more) and ``hex`` (32 or more hexadecimal digits)
are the base; a match that fails its length is dropped, though it has used up its characters.
``owned`` is added by the method: a run of 20 or more base-64 characters that looks random (a
digit, a lower-case and an upper-case letter, no word of ``PLACEHOLDERS``), overlaps no base
span, and is held by one owner alone.

Ownership. The values of all candidates are hashed (SHA-256). Each value gets its number of
distinct owners and of distinct (owner, repository) pairs over the whole corpus:

* ``example``: at least ``wide_owners`` owners hold it, or its text says so (``PLACEHOLDERS``);
* ``live``: one owner alone holds it, in however many repositories, and it looks random;
* ``shared``: the rest.

Scale. Texts are read once, in a narrow pass; candidates alone are written to the shared
folder, shuffled and joined. Holdings are made distinct by (value, owner, repository) and
counted by (value, owner), then by value, each step combined before it shuffles, so a value
that a third of all documents hold is no hot key. The join of candidates with the counted
values is a plain equi-join, whose large partitions Spark splits at run time.

Nulls: a null text holds no span; a null owner or repository counts as one more value of its
own. Empty texts hold none. Repeated rows come back as often as they came; they add nothing to
the distinct counts. An empty table gives an empty result. Columns of the input that aren't
named in ``keep`` are not returned, and kept ones may have any name but those added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import materialize

#: Kinds in the order of listing. The patterns of the base.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OWNED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: Words of example values: fixed values.
PLACEHOLDERS = r"(?i)example|sample|dummy|placeholder|changeme|change_me|your[_-]|xxxx|1234567|abcdef"
WIDE_OWNERS = 3


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    """An array of (gap before, length, value) for each leftmost non-overlapping match, in order; lengths in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)  # one more than the matches
    hits = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), value.alias("value")),
                       lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("len"), x["value"].alias("value")))
    none = F.array().cast("array<struct<gap:bigint,len:bigint,value:string>>")
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), hits).otherwise(none)


def _random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & ~value.rlike(PLACEHOLDERS)


def candidates(docs: DataFrame, text_col: str, keep: list[str], owner: Column, repo: Column) -> DataFrame:
    """A narrow pass: row, the kept columns as k0, k1 .., owner, repo, and the hits of each kind."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                       owner.cast("string").alias("owner"), repo.cast("string").alias("repo"),
                       _hits(text, ASSIGN, 2).alias("assign"), _hits(text, ACCESS).alias("access"), _hits(text, HEX).alias("hex"), _hits(text, OWNED).alias("owned"))


def spans_of(found: DataFrame) -> DataFrame:
    """row, owner, repo, kind, start, end, value: base spans that meet their length, and random runs that overlap none of them."""
    each = None
    for rank, kind in enumerate(KINDS):
        part = found.where(F.size(kind) > 0).select("row", "owner", "repo", F.lit(rank).alias("kind"), F.posexplode(kind).alias("pos", "h"))
        each = part if each is None else each.unionByName(part)
    in_order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("h.gap") + F.col("h.len")).over(in_order)).select(
        "row", "owner", "repo", "kind", (F.col("end") - F.col("h.len")).alias("start"), "end", F.col("h.value").alias("value"))
    base = (F.col("kind") > 0) & (F.col("kind") < 3) | (F.col("kind") == 0) & (F.length("value") >= 8)
    each = each.where(base | (F.col("kind") == 3) & _random(F.col("value")))
    # how far base spans that start no later reach, and where the next one starts: so those that overlap a candidate show
    up, down = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.desc("start"))
    each = each.withColumn("reach", F.max(F.when(F.col("kind") < 3, F.col("end"))).over(up)).withColumn("begin", F.min(F.when(F.col("kind") < 3, F.col("start"))).over(down))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("begin").isNull() | (F.col("begin") >= F.col("end")))
    return each.where((F.col("kind") < 3) | apart).drop("reach", "begin").withColumn("hash", F.sha2("value", 256))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos: distinct owners and (owner, repository) pairs that hold each value, over all rows."""
    held = spans.select("hash", "owner", "repo").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, owner_col: str = "source", repo_col: str = "doc_id",
         wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (all but the text by default) and ``secrets``.

    ``secrets`` is an array, by start and kind, of structs (kind, start, end, hash, n_owners,
    n_repos, verdict); starts and ends in code points, end exclusive.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    keep = [c for c in keep if c != "secrets"]
    found = materialize(candidates(docs, text_col, keep, F.col(f"`{owner_col}`"), F.col(f"`{repo_col}`")), "candidates")
    spans = materialize(spans_of(found), "spans")
    known = ownership(spans)
    plain = F.col("value").rlike(PLACEHOLDERS)
    random_like = ~plain & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    verdict = F.when(plain | (F.col("n_owners") >= wide_owners), "example").when((F.col("n_owners") == 1) & random_like, "live").otherwise("shared")
    judged = spans.join(known, "hash").withColumn("verdict", verdict).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    names = F.array(*[F.lit(k) for k in KINDS])
    lists = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "hash", "n_owners", "n_repos", "verdict"))).alias("s"))
    lists = lists.select("row", F.transform("s", lambda x: F.struct(names[x["kind"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hash"].alias("hash"),
                                                                      x["n_owners"].alias("n_owners"), x["n_repos"].alias("n_repos"), x["verdict"].alias("verdict"))).alias("secrets"))
    none = F.array().cast(lists.schema["secrets"].dataType)
    any_hit = F.greatest(*[F.size(k) for k in KINDS]) > 0
    rows = found.select("row", any_hit.alias("any"), *[f"k{i}" for i in range(len(keep))])
    with_hits = rows.where("any").join(lists, "row", "left")
    out = with_hits.withColumn("secrets", F.coalesce("secrets", none)).unionByName(rows.where("NOT any").withColumn("secrets", none))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "secrets")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and by verdict, a digest of the base spans, and all spans."""
    base = F.filter("secrets", lambda x: x["kind"] != "owned")

    def n(field: str, value: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x[field] == value)).cast("long")

    return scanned.select(F.col(f"`{id_col}`").alias(id_col), *[n("kind", k).alias(f"n_{k}") for k in KINDS],
                          F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
                          *[n("verdict", v).alias(f"n_{v}") for v in ("live", "shared", "example")])
