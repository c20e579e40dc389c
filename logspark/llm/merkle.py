"""Merkle manifest of a dataset with nested-interval labels (operator 12).

Leaves are digests of rows; in each group they ascend by rank, and every ARITY consecutive nodes become their parent until one is left, the
subroot. Subroots, ordered by group, are the leaves of one more tree of the same kind.

Each node carries the interval [lo, hi) of leaf ranks that it covers. A node of level k lies in the bucket lo div ARITY**k of its group, so the nodes above
and below meet by an equi-join on (group, bucket), and containment of the intervals makes one the ancestor of the other. Within a parent, the children whose
interval lies before or after a node's are its siblings. Paths are attached from the top: a child's path is its siblings, then its parent's path, so what all
leaves of a parent share is shuffled once a parent and no key has more than ARITY rows. Levels are a few (log of the rows), each a grouping of an
ARITY-th of the rows of the one below, written to the shared folder.

Ranks come from ranges of the whole order and prefix sums (ranks.py): a group may hold any share of the rows.

Cases: a null field is `-`, an empty one `0:`; null groups are a group of their own, the first; null ids come first in their group; rows that repeat an id are
leaves of their own, in the order of their digests; a group of one row has its leaf as subroot; an empty table gives no rows and no root. Fields are read by
name, so other columns may have any name. Texts of any length are hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .ranks import ranked

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field as it enters a leaf: `-`, or its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _joined(nodes: Column) -> Column:
    """Hexadecimal digests of an array of nodes, one after another."""
    return F.array_join(F.transform(nodes, lambda x: _hex(x["digest"])), "")


@dataclass
class Tree:
    """levels[0] are the leaves (grp, lo, hi, digest, n and their own columns); levels[k] are nodes (grp, lo, hi, digest, n, kids)."""

    levels: list[DataFrame]
    own: list[str]

    def nodes(self) -> DataFrame:
        """(grp, level, lo, hi, digest): all nodes with the leaf ranks that they cover."""
        out = [x.select("grp", F.lit(k).alias("level"), "lo", "hi", _hex(F.col("digest")).alias("digest")) for k, x in enumerate(self.levels)]
        whole = out[0]
        for x in out[1:]:
            whole = whole.unionByName(x)
        return whole

    def subroots(self) -> DataFrame:
        """(grp, digest, n): the node of each group that covers all its leaves. A level is built only where more than one node is left."""
        whole = None
        for x in self.levels:
            top = x.where("lo = 0 and hi = n").select("grp", "digest", "n")
            whole = top if whole is None else whole.unionByName(top)
        return whole


def build(leaves: DataFrame, order: list[Column], arity: int = ARITY) -> Tree:
    """A tree in each group of leaves (grp, digest binary, columns of their own), ranked by order, which begins with grp."""
    own = [c for c in leaves.columns if c not in ("grp", "digest")]
    bottom = cut(ranked(leaves, order, "grp").select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "n", *own))
    levels = [bottom]
    most = bottom.agg(F.max("n")).first()[0] or 0
    while arity ** (len(levels) - 1) < most:
        k = len(levels)
        below = levels[-1].where(F.col("n") > arity ** (k - 1))
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *(own if k == 1 else []))))  # arity of them at most
        level = below.groupBy("grp", F.expr(f"lo div {arity ** k}").alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), kids.alias("kids"))
        levels.append(cut(level.select("grp", "lo", "hi", F.unhex(F.sha2(_joined(F.col("kids")), 256)).alias("digest"), "n", "kids")))
    return Tree(levels, own)


def paths(tree: Tree, tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """A row for each leaf: (grp, lo, digest, its own columns, path, more), path being array<struct<left, right>> from the leaf up.

    tops: (grp, path, more columns): what lies above each group's subroot; a row a group.
    """
    more = [c for c in tops.columns if c not in ("grp", "path")]
    above = None  # nodes of the level at hand with their paths, from the level above it
    for k in range(len(tree.levels) - 1, -1, -1):
        level, width = tree.levels[k], arity ** k
        top = level.where("lo = 0 and hi = n").select(F.col("grp").alias("__g"), "lo", "hi").join(tops, F.col("__g").eqNullSafe(F.col("grp"))).select("__g", "lo", "hi", "path", *more)
        if k == 0:
            alone = level.where("n = 1")
            out = alone.join(top.select("__g", "path", *more), F.col("grp").eqNullSafe(F.col("__g"))).select("grp", "lo", "digest", *tree.own, "path", *more)
            return out if above is None else out.unionByName(above)
        held = top if above is None else above.unionByName(top)
        held = held.select(F.col("__g"), F.expr(f"lo div {width}").alias("__b"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "path", *more)
        inside = (F.col("grp").eqNullSafe(F.col("__g")) & (F.expr(f"lo div {width}") == F.col("__b")) & (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi")))
        met = level.select("grp", "lo", "hi", "kids").join(held, inside).select("grp", "kids", F.explode("kids").alias("kid"), "path", *more)
        sides = F.struct(_joined(F.filter("kids", lambda x: x["hi"] <= F.col("kid.lo"))).alias("left"), _joined(F.filter("kids", lambda x: x["lo"] >= F.col("kid.hi"))).alias("right"))
        path = F.concat(F.array(sides), F.col("path")).alias("path")
        if k == 1:
            above = met.select("grp", F.col("kid.lo").alias("lo"), F.col("kid.digest").alias("digest"), *[F.col(f"kid.{c}").alias(c) for c in tree.own], path, *more)
        else:
            above = met.select(F.col("grp").alias("__g"), F.col("kid.lo").alias("lo"), F.col("kid.hi").alias("hi"), path, *more)
    return above


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's hexadecimal digest leads to along a path."""
    return F.aggregate(path, digest, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


_NO_PATH = "array<struct<left:string,right:string>>"


def manifest(leaves: DataFrame, order: list[Column]) -> tuple[DataFrame, Tree, Tree]:
    """Paths to the one root for leaves (grp, digest, columns of their own): rows of paths() with subroot and root, the groups' trees, and the tree of subroots."""
    tree = build(leaves, order)
    tops = tree.subroots().select(F.lit(0).alias("grp"), "digest", F.col("grp").alias("__of"))
    crown = build(tops, [F.col("grp"), F.col("__of").asc_nulls_first()])
    root = crown.subroots().select("grp", F.lit(None).cast(_NO_PATH).alias("path"), _hex(F.col("digest")).alias("root"))
    root = root.withColumn("path", F.coalesce("path", F.array().cast(_NO_PATH)))
    above = paths(crown, root).select(F.col("__of").alias("grp"), "path", _hex(F.col("digest")).alias("subroot"), "root")
    return paths(tree, cut(above)), tree, crown


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = [F.col(c) for c in FIELDS]
    lower = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = cut(docs.select(F.col("lang").alias("grp"), "doc_id", F.unhex(leaf(plain)).alias("digest"), F.unhex(F.when(tampered, leaf(lower)).otherwise(leaf(plain))).alias("now")))
    found, _, _ = manifest(rows, [F.col("grp").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")])
    out = found.select("doc_id", _hex(F.col("digest")).alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(_hex(F.col("now")), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELDS_SQL = " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in FIELDS)
_LOWER_SQL = _FIELDS_SQL.replace("text::varchar", f"translate(text, '{_UPPER}', '{_LOWER}')")
# CRC-32 of the decimal id, bit by bit
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::bigint) ELSE d >> 1 END)), 4294967295::bigint)"""
SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, sha256({_FIELDS_SQL}) AS leaf, CASE WHEN {_CRC_SQL} % 3 = 0 THEN sha256({_LOWER_SQL}) ELSE sha256({_FIELDS_SQL}) END AS now FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM base
), tree AS (
  SELECT lang, 0 AS level, r AS idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value(n) FROM tree WHERE n > 8 ** level GROUP BY lang, level, idx // 8
), subroots AS (
  SELECT lang, max(level) AS depth, arg_max(h, level) AS subroot FROM tree WHERE idx = 0 GROUP BY lang
), tops AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS m FROM subroots
), crown AS (
  SELECT 0 AS level, k AS idx, subroot AS h, m FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value(m) FROM crown WHERE m > 8 ** level GROUP BY level, idx // 8
), root AS (
  SELECT arg_max(h, level) AS root FROM crown WHERE idx = 0
), sides AS (
  SELECT a.lang, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM tree a JOIN tree b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.idx // 8 = b.idx // 8
  WHERE a.n > 8 ** a.level GROUP BY a.lang, a.level, a.idx
  UNION ALL
  SELECT t.lang, t.depth + a.level, 0, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''), coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM tops t JOIN crown a ON a.idx = t.k // (8 ** a.level)::bigint JOIN crown b ON a.level = b.level AND a.idx // 8 = b.idx // 8
  WHERE a.m > 8 ** a.level GROUP BY t.lang, t.depth, a.level
), folds AS (
  SELECT row_number() OVER () AS no, doc_id, lang, leaf, 0 AS level, r AS idx, now AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.no, f.doc_id, f.lang, f.leaf, f.level + 1, f.idx // 8, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM folds f JOIN sides s ON f.lang IS NOT DISTINCT FROM s.lang AND f.level = s.level AND f.idx = s.idx
), ends AS (
  SELECT no, any_value(doc_id) AS doc_id, any_value(lang) AS lang, any_value(leaf) AS leaf, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM folds GROUP BY no
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ends JOIN subroots ON ends.lang IS NOT DISTINCT FROM subroots.lang CROSS JOIN root
"""
