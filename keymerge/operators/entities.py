"""Entity resolution (E1-E8) and OR-key merge.

Rows of all sources are nodes.  A link never emits row pairs: for every key
value the rows holding it point at the smallest row id holding it (a star
per value), which is linear in rows.  Components of the resulting graph are
found with alternating large-star / small-star rounds (Kiveris et al., 2014);
each round is checkpointed into the shared checkpoint folder, so lineage stays
short and a lost executor only recomputes one round.  The only thing that
reaches the driver is one emptiness test per round ("is this a star forest?").
With a single key or link the value stars already are the components and no
round runs at all.

Fuzzy links compare *distinct values*, not rows.  Candidate pairs come from a
prefix filter over character-occurrence tokens ordered by global rarity - an
exact filter for the edit-distance threshold (no true pair is missed) - and are
verified with ``levenshtein``.  Similar values are closed transitively into
value groups that then act as an exact key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Mapping as TMapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policies import PolicyExpr, ord_col, qual, src_col
from ..session import exchanged, materialize, written
from ..sources.readers import ordinal_expr
from .merge import key_text
from ..spec import Mapping, MergeSpec, Policy, SourceField, SpecError

ROW_ID = "_row_id"
SRC = "_src"
ENTITY = "entity_id"

# Derivations for semantic links.
EMAIL_RE = r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+[.][A-Za-z]{2,})"
EMAIL_FULL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def _with_at(c: Column, pattern: str, group: int) -> Column:
    # The regex can only match text holding an '@': test that first (same result, far cheaper).
    return F.when(F.instr(c, "@") > 0, F.lower(F.regexp_extract(c, pattern, group))).otherwise(F.lit(""))


DERIVATIONS: dict[str, Callable[[Column], Column]] = {
    "email_domain": lambda c: _with_at(c, EMAIL_RE, 1),
    "email": lambda c: _with_at(c, EMAIL_FULL_RE, 0),
    "phone_digits": lambda c: F.regexp_replace(c, r"[^0-9]", ""),
    "name_fold": lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")),
}


@dataclass(frozen=True)
class Link:
    """``left.left_on ~ right.right_on``.

    * ``kind="exact"`` (E1): equal values.
    * ``kind="semantic"`` (E3): equal *derived* values, ``derive`` names one of
      ``DERIVATIONS`` or is a ``Column -> Column`` function.
    * ``kind="fuzzy"`` (E2): similarity ``100 * (1 - lev / max_len) >= threshold``
      within equal ``block_on`` values (a block column on each side); without blocks only if
      ``compare_all`` says so, as all distinct values are then one block.

    ``weight`` says how strong the link is where clusters are split (``oversize="split"``).
    A link between two columns of one source joins the rows whose left value is another's right value.
    """

    left: str
    left_on: str
    right: str
    right_on: str
    kind: str = "exact"
    threshold: float = 100.0
    block_on: tuple[str, str] | None = None
    derive: str | Callable[[Column], Column] | None = None
    weight: float = 1.0
    compare_all: bool = False

    def __post_init__(self):
        if self.kind == "fuzzy" and not self.block_on and not self.compare_all:
            raise SpecError("a fuzzy link needs block_on; with compare_all=True all values are one block")

    def is_self(self) -> bool:
        return self.left == self.right and self.left_on == self.right_on


def _derive(link: Link, c: Column) -> Column:
    if link.kind != "semantic":
        return c
    d = link.derive or "name_fold"
    fn = DERIVATIONS[d] if isinstance(d, str) else d
    return fn(c)


def _empty_to_null(c: Column) -> Column:
    return F.when(c.cast("string") != F.lit(""), c)


# --------------------------------------------------------------- components
def _canon(df: DataFrame, a: str, b: str) -> DataFrame:
    return (df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .filter(F.col("u") != F.col("v")).distinct())


def _is_star_forest(e: DataFrame) -> bool:
    """True when no edge target is itself the source of an edge: every component is a
    star around its smallest node, which is the final answer.  One small job."""
    return e.join(exchanged(e.select(F.col("u").alias("v"))), "v", "left_semi").isEmpty()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected edge list.

    Returns ``(node, component)`` for every node that has an edge, where
    ``component`` is the smallest node id of its component.  Node ids may be
    any orderable type.  Rounds go on until the edge set is a star forest,
    which alternating large-star and small-star steps always reach.

    The minimum per node is written before it is joined to the edges, so that both
    sides of the join have an exchange of their own: only then does AQE split the
    edges of a hub over several tasks.  A round ends in a written table, whose size Spark knows:
    the estimated sizes of checkpointed tables would be multiplied by the joins of every round.
    No join of a round broadcasts: the tables are as long as the edges and would add up in the driver.
    """
    # The first round reads the (lazy) canonical edges directly: a star forest passes
    # through a round unchanged, so checking after each round is enough.
    e = _canon(edges, src, dst)
    while True:
        # large-star: every strictly larger neighbour of x attaches to min(N(x) + x)
        d = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        m = materialize(d.groupBy("x").agg(F.min("y").alias("_m")).select("x", F.least("x", "_m").alias("m")))
        # (y, m) with y > x >= m is already canonical; duplicates are removed after small-star
        e = materialize(d.join(exchanged(m), "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v")))
        # small-star: u and its smaller neighbours attach to min(N<=(u) + u)
        m2 = materialize(e.groupBy("u").agg(F.min("v").alias("m")))
        ss = e.join(exchanged(m2), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            m2.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = written(_canon(ss, "a", "b"), "cc")
        if _is_star_forest(e):
            roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# -------------------------------------------------------------- fuzzy values
def _max_edits(length: Column, threshold: float) -> Column:
    """Largest edit distance allowed at ``length`` for ``similarity >= threshold``.

    Used only to size candidate filters; the epsilon keeps them a superset of
    the final check when float rounding lands exactly on a boundary.
    """
    return F.floor(length * F.lit(100.0 - threshold) / F.lit(100.0) + F.lit(1e-9)).cast("int")


def _segment(la: str, k: str, i: str) -> tuple[str, str]:
    """SQL for the start (from 0) and length of segment ``i`` when a value of ``la`` characters is cut into
    ``k + 1`` segments, the longer ones last."""
    short = f"(({k} + 1) - {la} % ({k} + 1))"
    return f"({i} * ({la} div ({k} + 1)) + greatest(0, {i} - {short}))", f"({la} div ({k} + 1) + if({i} >= {short}, 1, 0))"


def _candidates(shorter: DataFrame, longer: DataFrame, threshold: float) -> DataFrame:
    """``(block, a, b)``: all pairs with ``a`` not longer than ``b`` that can be within ``b``'s edit budget ``k``.

    ``a`` is cut into ``k + 1`` segments.  ``k`` edits leave one of them whole, so it stands
    in ``b``; and where it may stand follows from its number and the difference in length.
    So both sides are joined on (length of ``a``, ``k``, number and text of the segment).
    """
    edits = f"cast(floor({{}} * {100.0 - threshold}D / 100D + 1e-9D) as int)"
    start, size = _segment("la", "k", "i")
    a = shorter.select("block", F.col("value").alias("a"), F.length("value").alias("la"))
    reach = f"cast(ceil(la * 100D / {threshold}D) as int) + 1"
    a = a.select("*", F.explode(F.expr(f"array_distinct(transform(sequence(la, {reach}), n -> {edits.format('n')}))")).alias("k"))
    a = a.select("*", F.explode(F.expr("sequence(0, k)")).alias("i"))
    a = a.select("block", "a", "la", "k", "i", F.expr(f"substring(a, {start} + 1, {size})").alias("part"))
    b = longer.select("block", F.col("value").alias("b"), F.length("value").alias("lb"))
    b = b.select("*", F.expr(edits.format("lb")).alias("k"))
    b = b.select("*", F.explode(F.expr("sequence(greatest(1, lb - k), lb)")).alias("la"))
    b = b.select("*", F.explode(F.expr("sequence(0, k)")).alias("i"))
    b = b.select("*", F.expr(start).alias("p"), F.expr(size).alias("n"))
    first = "greatest(0, p - i, p + (lb - la) - (k - i))"
    last = "least(lb - n, p + i, p + (lb - la) + (k - i))"
    b = b.select("*", F.explode(F.expr(f"if({first} <= {last}, sequence({first}, {last}), array())")).alias("s"))
    b = b.select("block", "b", "la", "k", "i", F.expr("substring(b, s + 1, n)").alias("part")).distinct()
    return a.join(b, ["block", "la", "k", "i", "part"]).select("block", "a", "b").filter("a != b").distinct()


def similar_values(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """E2 core: pairs of distinct values ``(block, a, b, distance, similarity)``.

    ``left``/``right`` hold columns ``block`` and ``value``.  With
    ``right=None`` the pairs are within ``left`` (``a < b``).  Candidates share a
    segment at a place where it can stand (``_candidates``; exact for the
    threshold) and are verified with ``levenshtein``.  Values without a block
    are compared with nothing.
    """
    def values(df: DataFrame) -> DataFrame:
        return df.select("block", "value").filter(F.col("block").isNotNull() & F.col("value").isNotNull() & (F.length("value") > 0)).distinct()

    lv = values(left)
    if right is None:
        cand = _candidates(lv, lv, threshold).select("block", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    else:
        rv = values(right)
        same = lv.join(rv, ["block", "value"]).select("block", F.col("value").alias("a"), F.col("value").alias("b"))
        cand = _candidates(lv, rv, threshold).unionByName(
            _candidates(rv, lv, threshold).select("block", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().unionByName(same)
    ml = F.greatest(F.length("a"), F.length("b"))
    dist = F.levenshtein("a", "b")
    return (cand.filter(F.abs(F.length("a") - F.length("b")) <= _max_edits(ml, threshold))
            .withColumn("distance", dist)
            .filter(F.col("distance") * F.lit(100.0) <= F.lit(100.0 - threshold) * ml)
            .withColumn("similarity", F.lit(100.0) * (F.lit(1.0) - F.col("distance").cast("double") / ml.cast("double"))))


# -------------------------------------------------------------------- nodes
def _build_nodes(sources: TMapping[str, DataFrame], used: list[str], links: Sequence[Link],
                 fields: list[SourceField], ids: TMapping[str, str] | None, order_by: TMapping[str, object] | None,
                 key_fields: list[list[SourceField]]) -> DataFrame:
    """Union of per-source projections: row id, source index, row order, link keys, mapped columns.

    Row ids are ``id * n_sources + source_index`` - from the caller's id
    columns when given, else from the scan order (then the table is
    checkpointed so the ids never change).
    """
    ids = dict(ids or {})
    order_by = dict(order_by or {})
    n = len(used)
    parts = []
    for i, s in enumerate(used):
        df = sources[s]
        types = dict(df.dtypes)
        rid = (_checked_id(df, s, ids[s]) if s in ids else F.monotonically_increasing_id()) * F.lit(n) + F.lit(i)
        cols = [rid.alias(ROW_ID), F.lit(i).alias(SRC), ordinal_expr(order_by.get(s), df).alias(ord_col(s))]
        for li, lk in enumerate(links):
            sides = []
            if lk.left == s:
                sides.append((lk.left_on, 2 if lk.is_self() else 0))
            if lk.right == s and not lk.is_self():
                sides.append((lk.right_on, 1))
            for (col_name, side), more in zip(sides, ("", "r")):  # a link of two columns of one source gives a row two keys
                key = _empty_to_null(_derive(lk, src_col(col_name)).cast("string") if lk.kind != "exact" else key_text(src_col(col_name), types[col_name]))
                if lk.kind == "fuzzy" and lk.block_on:
                    blk = lk.block_on[0] if side in (0, 2) else lk.block_on[1]
                    cols.append(src_col(blk).cast("string").alias(f"_lb{li}{more}"))
                cols += [key.alias(f"_lk{li}{more}"), F.lit(side).alias(f"_ls{li}{more}")]
        for ki, kf in enumerate(key_fields):
            own = [key_text(src_col(f.column), types[f.column]) for f in kf if f.source == s]
            if own:
                cols.append(F.array(*[_empty_to_null(k) for k in own]).alias(f"_kk{ki}"))
        seen = set()
        for f in fields:
            if f.source == s and f.column not in seen:
                seen.add(f.column)
                cols.append(src_col(f.column).alias(qual(s, f.column)))
        parts.append(df.select(*cols))
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if all(s in ids for s in used):
        # Ids come from the data: every rescan yields the same ids, and the lineage is a scan.
        return nodes
    # Scan-order ids must be fixed once, so every later step (and every retried task) sees them.
    return materialize(nodes, "nodes")


def _checked_id(df: DataFrame, source: str, column: str) -> Column:
    """The source's id column: whole numbers, none null (fails at the first one) and none twice."""
    if dict(df.dtypes)[column] not in ("bigint", "int", "smallint", "tinyint"):
        raise SpecError(f"ids of {source}: {column} is not a whole number")
    if not df.groupBy(src_col(column)).count().filter("count > 1").isEmpty():
        raise SpecError(f"ids of {source}: {column} holds an id twice")
    c = src_col(column).cast("bigint")
    return F.when(c.isNull(), F.raise_error(F.lit(f"ids of {source}: {column} holds a null")).cast("bigint")).otherwise(c)


def _value_star_edges(t: DataFrame, require_both_sides: bool) -> DataFrame:
    """Rows sharing a key value -> edges to the smallest row id holding it (no pairs)."""
    t = t.filter(F.col("key").isNotNull())
    if "block" in t.columns:
        t = t.drop("block")
    # Written first: both sides of the join then have an exchange, and AQE can split a hot value.
    anchors = t.groupBy("key").agg(F.min(ROW_ID).alias("anchor"), F.min("side").alias("_s0"),
                                   F.max("side").alias("_s1"))
    if require_both_sides:
        anchors = anchors.filter((F.col("_s1") == 2) | ((F.col("_s0") == 0) & (F.col("_s1") >= 1)))
    return (t.join(exchanged(materialize(anchors.select("key", "anchor"), "anchors")), "key")
            .filter(F.col(ROW_ID) != F.col("anchor"))
            .select(F.col(ROW_ID).alias("src"), F.col("anchor").alias("dst")))


def _link_keys(nodes: DataFrame, li: int, lk: Link) -> DataFrame:
    """``_row_id, block, key, side`` of a link, a row for each key that a node holds."""
    parts = []
    for more in ("", "r"):
        if f"_lk{li}{more}" in nodes.columns:
            block = F.col(f"_lb{li}{more}") if lk.kind == "fuzzy" and lk.block_on else F.lit("")
            parts.append(nodes.select(ROW_ID, block.alias("block"), F.col(f"_lk{li}{more}").alias("key"), F.col(f"_ls{li}{more}").alias("side")))
    return reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("side").isNotNull() & F.col("key").isNotNull() & F.col("block").isNotNull())


def _similar_pairs(keys: DataFrame, lk: Link) -> DataFrame:
    """Similar values of a fuzzy link: ``(block, a, b, distance, similarity)``."""
    vals = keys.select("block", F.col("key").alias("value"), "side")
    if lk.is_self():
        return similar_values(vals, None, lk.threshold)
    return similar_values(vals.filter(F.col("side") == 0), vals.filter(F.col("side") == 1), lk.threshold)


def _fuzzy_keys(keys: DataFrame, lk: Link) -> DataFrame:
    """Replace a fuzzy link's raw value by its value-group id (transitive closure of similar values)."""
    node = lambda b, v: F.concat_ws("\u0000", b, v)
    pairs = _similar_pairs(keys, lk)
    groups = components(pairs.select(node(F.col("block"), F.col("a")).alias("src"), node(F.col("block"), F.col("b")).alias("dst")))
    keyed = keys.withColumn("_vn", node(F.col("block"), F.col("key")))
    keyed = keyed.join(groups.select(F.col("node").alias("_vn"), F.col("component").alias("_vg")), "_vn", "left")
    return keyed.withColumn("key", F.coalesce("_vg", "_vn")).drop("_vn", "_vg")


def _fuzzy_links(keys: DataFrame, lk: Link) -> DataFrame:
    """Weighted links of a fuzzy link: rows with a value to the first of them, and the first rows of two
    similar values to each other, weaker by their similarity."""
    pairs = materialize(_similar_pairs(keys, lk))
    used = pairs.select("block", F.col("a").alias("key")).unionByName(pairs.select("block", F.col("b").alias("key"))).distinct()
    held = keys.join(used, ["block", "key"], "left_semi")
    first = materialize(held.groupBy("block", "key").agg(F.min(ROW_ID).alias("anchor")))
    same = held.join(first, ["block", "key"]).filter(F.col(ROW_ID) != F.col("anchor")).select(
        F.col(ROW_ID).alias("src"), F.col("anchor").alias("dst"), F.lit(float(lk.weight)).alias("weight"))
    ends = [first.select("block", F.col("key").alias(c), F.col("anchor").alias(e)) for c, e in (("a", "src"), ("b", "dst"))]
    near = pairs.filter("a <> b").join(ends[0], ["block", "a"]).join(ends[1], ["block", "b"])
    return same.unionByName(near.select("src", "dst", (F.lit(float(lk.weight)) * F.col("similarity") / 100).alias("weight")))


METHODS = ("transitive_closure", "union_find", "graph_clustering")


def resolve(sources: TMapping[str, DataFrame], links: Sequence[Link], fields: list[SourceField] = (),
            ids: TMapping[str, str] | None = None, order_by: TMapping[str, object] | None = None,
            key_fields: list[list[SourceField]] = (), max_cluster_size: int | None = None,
            method: str = "transitive_closure", oversize: str = "rows", key_weights: Sequence[float] | None = None) -> DataFrame:
    """Nodes with their ``entity_id`` (E4/E6).  ``_oversize`` marks rows of clusters above the bound.

    ``method``: ``transitive_closure`` and ``union_find`` give the same
    components (E4/E5); ``graph_clustering`` is components bounded by
    ``max_cluster_size`` (E6), which it requires.  ``oversize`` says what becomes of clusters
    above the bound: with ``rows`` each row is an entity of its own; with ``split`` the cluster is
    cut at its weakest links (``clusters.bounded_components``; links have the weight of their ``Link``,
    fuzzy ones also by similarity, and OR keys that of ``key_weights``, 1 by default).
    """
    if oversize not in ("rows", "split"):
        raise SpecError("oversize must be rows or split")
    if method not in METHODS:
        raise SpecError(f"Unknown resolution method: {method}")
    if method == "graph_clustering" and not max_cluster_size:
        raise SpecError("graph_clustering needs max_cluster_size")
    used = _used_sources(links, key_fields)
    for f in fields:
        if f.source not in used:
            raise SpecError(f"Mapping reads source {f.source}, which no link or key reaches")
    for lk in links:
        if lk.kind == "fuzzy" and lk.threshold <= 0:
            raise SpecError("fuzzy threshold must be > 0")
        if lk.kind not in ("exact", "fuzzy", "semantic"):
            raise SpecError(f"Unknown link kind: {lk.kind}")
    nodes = _build_nodes(sources, used, links, list(fields), ids, order_by, list(key_fields))
    split = oversize == "split" and max_cluster_size is not None
    edge_sets = []
    for li, lk in enumerate(links):
        keys = _link_keys(nodes, li, lk)
        if lk.kind == "fuzzy" and split:
            edge_sets.append(_fuzzy_links(keys, lk))
            continue
        if lk.kind == "fuzzy":
            keys = _fuzzy_keys(keys, lk)
        edge_sets.append(_value_star_edges(keys, require_both_sides=not lk.is_self()).withColumn("weight", F.lit(float(lk.weight))))
    for ki in range(len(key_fields)):
        t = nodes.select(ROW_ID, F.explode(f"_kk{ki}").alias("key"), F.lit(2).alias("side"))
        edge_sets.append(_value_star_edges(t, require_both_sides=False).withColumn("weight", F.lit(float(key_weights[ki] if key_weights else 1.0))))
    if split:
        from .clusters import bounded_components

        edges = reduce(lambda a, b: a.unionByName(b), edge_sets)
        parts = bounded_components(edges, max_cluster_size).select(F.col("node").alias(ROW_ID), F.col("component").alias(ENTITY))
        out = nodes.join(exchanged(parts), ROW_ID, "left").withColumn(ENTITY, F.coalesce(ENTITY, ROW_ID))
        return out.withColumn("_oversize", F.lit(False)).withColumn("_cluster", F.col(ENTITY))
    several = any(len({f.source for f in kf}) < len(kf) for kf in key_fields)  # a row may hold several values
    several = several or any(lk.left == lk.right and not lk.is_self() for lk in links)
    if len(edge_sets) == 1 and not several:
        # One key: each row already points at the smallest row holding its value, and
        # value groups are disjoint, so the stars are the components - no rounds needed.
        e = edge_sets[0]
        comp = e.select(F.col("src").alias(ROW_ID), F.col("dst").alias(ENTITY)).unionByName(
            e.select(F.col("dst").alias(ROW_ID), F.col("dst").alias(ENTITY)).distinct())
        out = nodes.join(comp, ROW_ID, "left").withColumn(ENTITY, F.coalesce(F.col(ENTITY), F.col(ROW_ID)))
    elif edge_sets:
        edges = reduce(lambda a, b: a.unionByName(b), edge_sets)
        comp = components(edges).select(F.col("node").alias(ROW_ID), F.col("component").alias(ENTITY))
        out = nodes.join(exchanged(comp), ROW_ID, "left").withColumn(ENTITY, F.coalesce(F.col(ENTITY), F.col(ROW_ID)))
    else:
        out = nodes.withColumn(ENTITY, F.col(ROW_ID))
    if max_cluster_size:
        sizes = materialize(out.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("_size")), "sizes")
        out = out.join(sizes, ENTITY)
        over = F.col("_size") > F.lit(max_cluster_size)
        out = (out.withColumn("_oversize", over).withColumn("_cluster", F.col(ENTITY))
               .withColumn(ENTITY, F.when(over, F.col(ROW_ID)).otherwise(F.col(ENTITY))).drop("_size"))
    else:
        out = out.withColumn("_oversize", F.lit(False)).withColumn("_cluster", F.col(ENTITY))
    return out


def entity_merge(sources: TMapping[str, DataFrame], links: Sequence[Link], mappings: Sequence[Mapping],
                 ids: TMapping[str, str] | None = None, order_by: TMapping[str, object] | None = None,
                 max_cluster_size: int | None = None, key_fields: list[list[SourceField]] = (),
                 with_size: bool = True, method: str = "transitive_closure", oversize: str = "rows",
                 key_weights: Sequence[float] | None = None) -> DataFrame:
    """One row per entity with every mapping applied over all of its rows.

    All policies go into a single ``groupBy(entity_id).agg``.  Rows are unioned
    (no join), so nothing fans out; first/last/list policies follow
    (source order, row order).
    """
    from .merge import numeric_inputs

    sources, mappings = numeric_inputs(sources, list(mappings))
    fields = [f for m in mappings for f in m.fields]
    nodes = resolve(sources, links, fields, ids, order_by, key_fields, max_cluster_size, method, oversize, key_weights)
    return merge_nodes(nodes, mappings, _used_sources(links, key_fields), with_size)


def merge_nodes(nodes: DataFrame, mappings: Sequence[Mapping], used: list[str], with_size: bool = True) -> DataFrame:
    """One row per ``entity_id`` of ``nodes``, with every mapping applied."""
    pols = [PolicyExpr(m, i) for i, m in enumerate(mappings)]
    row_order = F.struct(F.col(SRC), *[F.col(ord_col(s)) for s in used])
    aggs = []
    for p in pols:
        own = {f.source for f in p.fields}
        if p.kind in ("row_sum", "row_means") and len(own) > 1:
            raise SpecError(f"policy {p.kind} adds the fields of a row: an entity's rows come from one source each")
        aggs.append(p.row_agg(row_order, F.col(SRC) == used.index(p.listed[0].source) if len(own) == 1 and len(used) > 1 else None))
    if with_size:
        aggs.append(F.count(F.lit(1)).alias("n_members"))
    return nodes.groupBy(ENTITY).agg(*aggs)


def _used_sources(links, key_fields) -> list[str]:
    used: list[str] = []
    for lk in links:
        for s in (lk.left, lk.right):
            if s not in used:
                used.append(s)
    for group in key_fields:
        for f in group:
            if f.source not in used:
                used.append(f.source)
    return used


def or_key_merge(sources: TMapping[str, DataFrame], spec: MergeSpec, order_by=None, cast: bool = False,
                 ids: TMapping[str, str] | None = None, max_cluster_size: int | None = None, oversize: str = "rows") -> DataFrame:
    """Rows that share *any* key value (within or across sources) form one entity.

    Output: ``entity_id``, each key as firstMatch (source order, then row
    order), then the value mappings.
    """
    key_fields, maps = or_plan(sources, spec)
    out = entity_merge(sources, [], maps, ids=ids, order_by=order_by, max_cluster_size=max_cluster_size,
                       key_fields=key_fields, with_size=False, oversize=oversize)
    return or_columns(out, spec, maps, cast)


def or_plan(sources: TMapping[str, DataFrame], spec: MergeSpec) -> tuple[list[list[SourceField]], list[Mapping]]:
    """The key fields of an OR-key merge, and its mappings: keys by first match, values, passed-through columns."""
    from .merge import _passthrough_mappings

    km = spec.key_mappings()
    key_fields = [list(m.fields) for m in km]
    key_maps = [Mapping(m.destination, Policy("firstMatch"), m.fields) for m in km]
    through = [Mapping(m.destination, Policy("firstMatch"), m.fields) for m in _passthrough_mappings(spec, sources, _used_sources([], key_fields))]
    return key_fields, key_maps + spec.value_mappings() + through


def or_columns(out: DataFrame, spec: MergeSpec, maps: list[Mapping], cast: bool = False) -> DataFrame:
    """The destination's columns, cast to their declared types where asked for."""
    names = [ENTITY] + ([d.name for d in spec.destination] or [m.destination for m in maps])
    types = {d.name: d.data_type for d in spec.destination}
    if not cast:
        return out.select(*names)
    from ..spec import TYPE_NAMES

    return out.select(ENTITY, *[F.col(n).try_cast(TYPE_NAMES[types[n]]).alias(n)
                                if n in types and types[n] in TYPE_NAMES else F.col(n) for n in names[1:]])


def link_pairs(sources: TMapping[str, DataFrame], link: Link) -> DataFrame:
    """E2 report: similar distinct value pairs ``(block, a, b, distance, similarity)`` of a fuzzy link."""
    if link.kind != "fuzzy":
        raise SpecError("link_pairs is for fuzzy links")
    if not link.block_on:
        blk_l = blk_r = F.lit("")
    else:
        blk_l, blk_r = src_col(link.block_on[0]).cast("string"), src_col(link.block_on[1]).cast("string")
    lv = sources[link.left].select(blk_l.alias("block"), src_col(link.left_on).cast("string").alias("value"))
    if link.is_self() and (not link.block_on or link.block_on[0] == link.block_on[1]):
        return similar_values(lv, None, link.threshold)
    rv = sources[link.right].select(blk_r.alias("block"), src_col(link.right_on).cast("string").alias("value"))
    return similar_values(lv, rv, link.threshold)
