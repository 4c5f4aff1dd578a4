"""Operator 13: Merkle manifest of a dataset, by nested-interval labels.

Leaves are ranked within their tree (a language), and every node carries the interval of leaf ranks that it covers, so
that a node's ancestors are those whose intervals contain its own. Levels are taken in bands of BAND: the nodes of a band
below one node of its top level are a bucket, of at most 2 ** BAND nodes at its lowest level. A containment join by
bucket attaches to each bucket the one that holds its top node, and so, band by band, all its ancestors. Within a parent,
the interval less a node's own is its sibling's. The roots of the trees are the leaves of one more tree, made alike.

DataFrame functions only. A bucket is a row of bounded size; a tree, however large, is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stage

#: Levels of a band.
BAND = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tampering touches the rows whose unsigned crc32 of the decimal doc_id this number divides.
EVERY = 7


def digest_of(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of values, each `-` if null, else its length in UTF-8 bytes, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return digest_of(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def tree_key(lang: Column) -> Column:
    """A text that is never null and sorts as ``lang`` does bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (tree, ...) with rank, from 0 within the tree by ``order`` (nulls first), and n, the leaves of the tree.

    Rows are dealt by ranges of (tree, order); what a range adds to the ranks of the next ones is one row for each tree
    in it. Rows that are equal in ``order`` are parted by their place in the input, so that no range is all one key.
    """
    dealt = rows.withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange("tree", *order, "_at").sortWithinPartitions("tree", *order, "_at").drop("_at")
    placed = stage(dealt.withColumn("_place", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = placed.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_add"), F.sum("_n").over(tree).alias("n"))
    found = placed.join(stage(parts, f"{name}-ranges"), ["tree", "_part"])
    return found.withColumn("rank", F.col("_place") + F.col("_add")).drop("_part", "_place", "_add")


def height(n: Column) -> Column:
    """Levels above the leaves, until one node is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _levels(nodes: Column, steps: Column) -> Column:
    """The node lists of a bucket, level by level: every two consecutive nodes become one that covers both intervals."""

    def up(below: Column, j: Column) -> Column:
        a, b = F.get(below, 2 * j), F.get(below, 2 * j + 1)
        return F.struct(a["lo"].alias("lo"), F.coalesce(b["hi"], a["hi"]).alias("hi"), digest_of(a["digest"], F.coalesce(b["digest"], F.lit(""))).alias("digest"))

    def add(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        pairs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        return F.concat(levels, F.array(F.transform(pairs, lambda j: up(below, j))))

    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), F.array(nodes), add)).otherwise(F.array(nodes))


def _no_siblings() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def _siblings(levels: Column, base: Column, low: int, lo: Column) -> Column:
    """(left, right) digests of the siblings of each node of a bucket that contains rank ``lo``, below its top node.

    ``low``: the bucket's lowest level. A node's interval is that of its level which contains ``lo``; its parent's, less
    that, is the sibling's: to its left or right, or empty, where the last node of a level is alone.
    """

    def at(level: Column, rank: Column) -> Column:
        return F.get(F.get(levels, level), F.call_function("shiftright", rank - base, level + low).cast("int"))

    def beside(k: Column) -> Column:
        own, parent = at(k, lo), at(k + 1, lo)
        left = F.when(parent["lo"] < own["lo"], at(k, parent["lo"])["digest"])
        right = F.when(own["hi"] < parent["hi"], at(k, own["hi"])["digest"])
        return F.struct(left.alias("left"), right.alias("right"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), beside)).otherwise(_no_siblings())


def build(leaves: DataFrame, name: str, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(buckets, roots) of the trees over ``leaves`` (tree, rank, n, digest, payload struct).

    buckets: tree, base, rows (the leaves, by rank), levels (array by level of nodes lo, hi, digest) and path (siblings
    from the bucket's top node to the tree's root). roots: tree, digest.
    """
    node = F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("digest"), F.col("payload"))
    grouped = leaves.groupBy("tree", F.shiftright("rank", band).alias("bucket")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(node)).alias("rows"))
    bare = F.transform("rows", lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), r["digest"].alias("digest")))
    steps = F.least(height(F.col("n")), F.lit(band)).cast("int")
    bands = [stage(grouped.withColumn("levels", _levels(bare, steps)).withColumn("base", F.shiftleft("bucket", band)), f"{name}-band-0")]
    tops = []
    while True:
        done = len(bands) * band
        top = F.get(F.element_at("levels", -1), F.lit(0))
        tops.append(bands[-1].where(height(F.col("n")) <= done).select("tree", top["digest"].alias("digest")))
        more = bands[-1].where(height(F.col("n")) > done).select("tree", "n", top.alias("top"))
        if more.isEmpty():
            break
        bucket = F.shiftright(F.col("top")["lo"], done + band)
        grouped = more.groupBy("tree", bucket.alias("bucket")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list("top")).alias("nodes"))
        steps = F.least(height(F.col("n")) - done, F.lit(band)).cast("int")
        bands.append(stage(grouped.select("tree", "bucket", "n", _levels(F.col("nodes"), steps).alias("levels"), F.shiftleft("bucket", done + band).alias("base")), f"{name}-band-{len(bands)}"))
    above = bands[-1].withColumn("path", _no_siblings())
    for k in range(len(bands) - 2, -1, -1):
        above = _attach(bands[k], above, band * (k + 1), band)
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return above, stage(roots, f"{name}-roots")


def _attach(buckets: DataFrame, above: DataFrame, low: int, band: int) -> DataFrame:
    """``buckets`` with path: a containment join with the buckets of the band above, whose lowest level is ``low``.

    Both sides are bucketed by the level of the upper one's top node; of trees that end in the lower band nothing is above.
    """
    top = F.get(F.element_at("levels", -1), F.lit(0))
    lower = buckets.withColumn("lo", top["lo"]).withColumn("hi", top["hi"]).withColumn("up", F.shiftright("base", low + band))
    upper = above.select(
        F.col("tree").alias("u_tree"), F.col("bucket").alias("u_bucket"), F.col("base").alias("u_base"), F.col("levels").alias("u_levels"),
        F.col("path").alias("u_path"), top["lo"].alias("u_lo"), top["hi"].alias("u_hi"),
    )
    joined = lower.join(upper, (F.col("tree") == F.col("u_tree")) & (F.col("up") == F.col("u_bucket")) & (F.col("u_lo") <= F.col("lo")) & (F.col("hi") <= F.col("u_hi")), "left")
    path = F.concat(_siblings(F.col("u_levels"), F.col("u_base"), low, F.col("lo")), F.col("u_path"))
    return joined.select(*[joined[c] for c in buckets.columns], F.when(F.col("u_levels").isNull(), _no_siblings()).otherwise(path).alias("path"))


def manifest(df: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each row of ``df`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified.

    A leaf is the digest of a row; a tree holds the leaves of a language by doc_id, null ids first, rows of the same id by
    their digests; its root is the subroot, and the tree of all subroots, by language (null first), has the root.
    proof_sha256 is the digest of a leaf's siblings on the way to the root. folded_root is made again from those siblings
    and the row as tampered with (n_chars greater by 1, where EVERY divides the crc32 of doc_id; a null id or n_chars
    stays), so it is the root, and verified is true, for rows left alone only. Null values count as such, empty and long
    texts as any other. A repeated row is a leaf of its own. Other columns, whatever their names, are not read. An empty
    table gives no rows.
    """
    value = dict(zip(FIELDS, (df[c] for c in FIELDS), strict=True))
    bent = value | {"n_chars": value["n_chars"].cast("decimal(38,0)") + 1}
    touched = (F.crc32(value["doc_id"].cast("string").cast("binary")) % EVERY == 0) & value["n_chars"].isNotNull()
    leaves = df.select(
        tree_key(value["lang"]).alias("tree"), value["doc_id"].alias("doc_id"), leaf_digest(*value.values()).alias("digest"), F.when(touched, leaf_digest(*bent.values())).alias("bent")
    )
    leaves = ranked(leaves, ["doc_id", "digest"], "leaves")
    buckets, subroots = build(leaves.select("tree", "rank", "n", "digest", F.struct("doc_id", "bent").alias("payload")), "leaf", band)
    trees = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "subroots")
    top, root = build(trees.select("tree", "rank", "n", "digest", F.struct("name").alias("payload")), "subroot", band)
    named = _leaves(top, "tree").join(root.withColumnRenamed("digest", "root"), "tree")
    named = stage(named.select(F.col("payload.name").alias("tree"), F.col("digest").alias("subroot"), F.col("siblings").alias("tree_path"), "root"), "trees")
    rows = _leaves(buckets.join(named, "tree"), "subroot", "root", "tree_path")
    path = F.concat("siblings", "tree_path")
    joined = F.array_join(F.transform(path, lambda s: F.concat(F.coalesce(s["left"], F.lit("")), F.coalesce(s["right"], F.lit("")))), "")
    folded = F.aggregate(path, F.coalesce("payload.bent", "digest"), lambda d, s: digest_of(F.coalesce(s["left"], F.lit("")), d, F.coalesce(s["right"], F.lit(""))))
    out = rows.select(F.col("payload.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", digest_of(joined).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaves(buckets: DataFrame, *more: str) -> DataFrame:
    """The leaves of ``buckets``, each with its siblings up to the root of its tree."""
    rows = buckets.select("base", "levels", "path", *more, F.explode("rows").alias("r"))
    return rows.select(*more, "r.payload", "r.digest", F.concat(_siblings(F.col("levels"), F.col("base"), 0, F.col("r.lo")), F.col("path")).alias("siblings"))


#: The same result for DuckDB: levels by recursion, crc32 by a table of its own.
SQL = """
WITH RECURSIVE bits AS (SELECT b, 0 AS k, b AS c FROM range(256) AS t(b)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT b, c FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
steps AS (SELECT doc_id, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM ids
    UNION ALL SELECT p.doc_id, p.s, p.i + 1, xor(p.c >> 8, t.c) FROM steps p JOIN crc_table t ON t.b = xor(p.c & 255, ascii(substr(p.s, p.i + 1, 1))) WHERE p.i < length(p.s)),
crc AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM steps WHERE i = length(s)),
texts AS (SELECT d.doc_id, d.lang, CASE WHEN d.lang IS NULL THEN '' ELSE '=' || d.lang END AS tree,
    coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(d.source) || ':' || d.source, '-') || coalesce(strlen(d.lang) || ':' || d.lang, '-') AS a,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS b, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS bent,
    coalesce(strlen(d.text) || ':' || d.text, '-') AS c, crc.crc % 7 = 0 AS touched FROM documents d LEFT JOIN crc USING (doc_id)),
leaves AS (SELECT doc_id, tree, sha256(a || b || c) AS leaf, CASE WHEN touched THEN sha256(a || bent || c) ELSE sha256(a || b || c) END AS held FROM texts),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS level, rank AS i, n, leaf AS digest FROM placed
    UNION ALL SELECT tree, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2),
subroots AS (SELECT tree, digest, level, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, rank AS i, n, digest FROM subroots
    UNION ALL SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2),
tree_steps AS (SELECT s.tree, t.level, t.i, b.digest AS sibling FROM subroots s JOIN tops t ON t.i = s.rank >> t.level AND t.n > 1 LEFT JOIN tops b ON b.level = t.level AND b.i = xor(t.i, 1)),
leaf_steps AS (SELECT p.tree, p.rank, t.level, t.i, b.digest AS sibling FROM placed p JOIN nodes t ON t.tree = p.tree AND t.i = p.rank >> t.level AND t.n > 1
    LEFT JOIN nodes b ON b.tree = p.tree AND b.level = t.level AND b.i = xor(t.i, 1)),
steps_of AS (SELECT tree, rank, level, i, sibling FROM leaf_steps
    UNION ALL SELECT p.tree, p.rank, s.level + t.level, t.i, t.sibling FROM placed p JOIN subroots s USING (tree) JOIN tree_steps t USING (tree)),
folds AS (SELECT tree, rank, 0 AS level, held AS digest FROM placed
    UNION ALL SELECT f.tree, f.rank, f.level + 1, sha256(CASE WHEN s.i % 2 = 1 THEN s.sibling || f.digest ELSE f.digest || coalesce(s.sibling, '') END)
    FROM folds f JOIN steps_of s ON s.tree = f.tree AND s.rank = f.rank AND s.level = f.level),
folded AS (SELECT tree, rank, max_by(digest, level) AS folded_root FROM folds GROUP BY tree, rank),
proofs AS (SELECT tree, rank, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY level)) AS proof FROM steps_of GROUP BY tree, rank),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.root, coalesce(x.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM placed p JOIN subroots s USING (tree) CROSS JOIN root LEFT JOIN proofs x ON x.tree = p.tree AND x.rank = p.rank JOIN folded f ON f.tree = p.tree AND f.rank = p.rank
"""
