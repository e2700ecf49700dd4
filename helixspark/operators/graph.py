"""Knowledge graphs: seeds, budgeted expansion, text. Tables: nodes(id, name, type, desc, pos), edges(src, dst, type)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.functions.text import reversed_type
from helixspark.sources.staging import Grown, Stage

#: Share, least and most nodes by type.
BUDGETS = {"Transcript": (0.10, 3, 12), "Protein": (0.30, 10, 40), "Drug": (0.16, 4, 24), "Disease": (0.14, 4, 20), "Pathway": (0.10, 3, 15), "Phenotype": (0.10, 3, 15), "Metabolite": (0.10, 3, 15), "Exposure": (0.06, 2, 10), "Gene": (0.12, 3, 20), "Microbiota": (0.06, 2, 10), "Promoter": (0.05, 2, 8), "*": (0.08, 2, 12)}
#: Score by type, and by edge type.
TYPE_BONUS = {"Drug": 2.5, "Disease": 2.2, "Pathway": 1.8, "Phenotype": 1.6, "Metabolite": 1.4, "Gene": 1.2, "Protein": 0.6, "Transcript": 0.0}
EDGE_BONUS = {"Drug-Protein": 2.6, "Protein-Drug": 2.6, "Drug-Disease": 2.4, "Disease-Drug": 2.4, "Protein-Disease": 2.0, "Disease-Protein": 2.0, "Protein-Pathway": 1.7, "Pathway-Protein": 1.7, "Protein-Phenotype": 1.5, "Phenotype-Protein": 1.5, "Metabolite-Protein": 1.4, "Protein-Metabolite": 1.4, "Gene-Transcript": 0.6, "Transcript-Protein": 0.8, "Protein-Protein": -0.2}
#: Edge types that get a reverse, and the order of types for seeds.
BIDIRECTIONAL = ["Drug-Protein", "Drug-Disease", "Drug-Pathway", "Drug-Metabolite", "Metabolite-Protein", "Metabolite-Disease"]
TYPE_ORDER = ["Gene", "Drug", "Protein", "Transcript", "Disease", "Pathway", "Phenotype", "Metabolite", "Exposure"]
SMALL_TYPE_ORDER = ["Drug", "Gene", "Protein", "Pathway", "GO"]
#: A node is a hub beyond so many times the edges of one kind that a seed can need of it.
HUB = 4
#: Rows of edges that one task takes.
TASK_ROWS = 200_000


def type_caps(max_nodes: int, budgets: Mapping[str, tuple[float, int, int]] = BUDGETS) -> dict[str, int]:
    """Most nodes of each type: its share of max_nodes, rounded half-even, within its bounds."""
    return {t: min(max(low, round(max_nodes * share)), high, max_nodes) for t, (share, low, high) in budgets.items()}


def entity_type(id_: Column, names: Mapping[str, str]) -> Column:
    """The type that an id's prefix stands for; prefixes not in ``names`` are capitalised; ids without one are Unknown."""
    prefix = F.substring_index(id_, ":", 1)
    known = F.coalesce(*(F.when(prefix == k, F.lit(v)) for k, v in names.items()), F.initcap(prefix)) if names else F.initcap(prefix)
    return F.when(F.contains(id_, F.lit(":")), known).otherwise(F.lit("Unknown"))


def allowed_edges(edges: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Edges with all three parts, of the given types."""
    trimmed = edges.select(*(F.trim(c).alias(c) for c in ("src", "dst", "type"))).where("src <> '' and dst <> '' and type <> ''")
    return trimmed.where(F.col("type").isin(list(types))) if types else trimmed


def both_ways(edges: DataFrame, types: Sequence[str] | None = BIDIRECTIONAL, prefix: str | None = None) -> DataFrame:
    """Adds reversed edges: of the listed types as B-A, or (types None) of all with a prefix."""
    some = edges if types is None else edges.where(F.col("type").isin(list(types)))
    return edges.unionByName(some.select(F.col("dst").alias("src"), F.col("src").alias("dst"), reversed_type(F.col("type"), prefix).alias("type")))


def _literal_map(values: Mapping[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v))))) if values else None
    return F.coalesce(F.try_element_at(table, key), F.lit(float(default))) if table is not None else F.lit(float(default))


def _grams(text: Column, size: Column) -> Column:
    """The distinct pieces of ``size`` characters of a text; none of a shorter one."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, size)))


def holding(names: DataFrame, seeds: DataFrame, best: Column, size: int = 3) -> DataFrame:
    """(key, best): of all names that hold a seed, the least ``best``, a struct made of a name's columns (low first among them) and key.

    A name that holds a seed has all of the seed's pieces of ``size`` characters, so a seed only meets the names with the
    piece that fewest names have: an equi-join, then the test itself. A shorter seed is its own piece: names are cut in its size,
    and each piece keeps its best name before anything is shuffled, so no pairs are made for it. The best of a longer seed is taken within
    each task first as well: what is shuffled is bounded by seeds, not by the names that hold them. Nothing is broadcast and no two tables are crossed.
    """
    low, key = F.col("low"), F.col("key")
    asked = seeds.withColumn("_size", F.least(F.length(key), F.lit(size)))
    sizes = sorted(r[0] for r in asked.select("_size").distinct().collect())  # ``size`` rows at most
    cut = lambda some: F.array_distinct(F.flatten(F.array(*(F.coalesce(_grams(low, F.lit(n)), F.array().cast("array<string>")) for n in some)))) if some else F.array().cast("array<string>")
    short = seeds.where(F.length(key) < size)
    own = names.withColumn("key", F.explode(cut([n for n in sizes if n < size]))).join(short.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(best).alias("best"))
    pieces = asked.where(F.length(key) >= size).select("key", F.explode(_grams(key, F.col("_size"))).alias("_gram")).distinct()
    had = names.withColumn("_gram", F.explode(cut([n for n in sizes if n == size])))
    rare = had.join(pieces.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = pieces.join(rare, "_gram").groupBy("key").agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    return own.unionByName(had.join(rarest, "_gram").where(F.contains(low, key)).groupBy("key").agg(F.min(best).alias("best")))


def resolve_seeds(seeds: DataFrame, nodes: DataFrame, type_order: Sequence[str] = TYPE_ORDER, fuzzy_rank: bool = False) -> DataFrame:
    """(seed, id, name, type, status): exact names before names that hold the seed, then types in order, then position.

    ``fuzzy_rank`` orders partial matches by whole word, prefix, anywhere, then shorter names, also matches ids, and falls
    back to the raw id; else the first entity by position with a name that holds the seed decides the candidates. Exact
    matches are an equi-join; seeds without one meet the names by ``holding``, a name once however many entities share it.
    """
    asked = seeds.select("seed", F.lower(F.trim("seed")).alias("key")).where("key <> ''").distinct()
    entity = nodes.select("id", "name", "type", "pos", F.lower("name").alias("low"))
    names = entity.select("id", "name", "type", "pos", "low")
    if fuzzy_rank:
        names = names.unionByName(entity.withColumn("low", F.lower("id"))).unionByName(entity.withColumn("low", F.lower(F.substring_index("id", ":", -1)))).distinct()
    order = F.coalesce(*(F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(type_order)), F.lit(len(type_order)))
    names = names.where("low is not null").withColumn("order", order)
    told = [F.col(c) for c in ("pos", "id", "name", "type")]
    exact = asked.join(names, F.col("key") == F.col("low")).groupBy("seed").agg(F.min(F.struct("order", *told)).alias("x")).select("seed", "x.id", "x.name", "x.type")
    rest = asked.join(exact.select("seed"), "seed", "left_anti")
    if fuzzy_rank:
        # of entities with one name and one place in the order of types, none but the first can be chosen
        once = names.groupBy("low", "order").agg(F.min(F.struct(*told)).alias("e"))
        low, key = F.concat(F.lit(" "), F.col("low"), F.lit(" ")), F.concat(F.lit(" "), F.col("key"), F.lit(" "))
        rank = F.when(F.contains(low, key), 1).when(F.col("low").startswith(F.col("key")), 2).otherwise(3)
        best = F.struct("order", rank.alias("rank"), F.length("low").alias("size"), "e", "low")
    else:
        once = names.groupBy("low").agg(F.min("pos").alias("first"), F.min(F.struct("order", *told)).alias("e"))
        best = F.struct("first", "low", "e")
    part = rest.join(holding(once, rest.select("key").distinct(), best), "key").select("seed", "best.e.id", "best.e.name", "best.e.type")
    chosen = exact.unionByName(part).select("seed", "id", F.coalesce("name", "id").alias("name"), F.coalesce("type", F.lit("Unknown")).alias("type"))
    out = seeds.select("seed").distinct().join(chosen, "seed", "left")
    if fuzzy_rank:
        raw = nodes.select(F.col("id").alias("_raw"), F.col("name").alias("_rn"), F.col("type").alias("_rt"))
        out = out.join(raw, F.col("id").isNull() & (F.col("seed") == F.col("_raw")), "left").select("seed", F.coalesce("id", "_raw").alias("id"), F.coalesce("name", "_rn", "_raw").alias("name"), F.coalesce("type", "_rt").alias("type"))
    return out.withColumn("status", F.when(F.col("id").isNull(), "not found").otherwise("ok"))


def scores(candidates: DataFrame, type_bonus: Mapping[str, float] = TYPE_BONUS, edge_bonus: Mapping[str, float] = EDGE_BONUS) -> Column:
    """Of rows (node_type, edge_type, n_type, and desc or told): bonuses, 0.8 with a description, and more while the type is rare."""
    told = F.col("told") if "told" in candidates.columns else _told(F.col("desc"))
    described = F.when(told, 0.8).otherwise(0.0)
    return F.round(_literal_map(type_bonus, F.col("node_type"), 0.4) + _literal_map(edge_bonus, F.col("edge_type"), 0.0) + described + F.greatest(F.lit(0.0), 1.8 - 0.35 * F.col("n_type")), 9)


def _told(desc: Column) -> Column:
    return F.trim(F.coalesce(desc, F.lit(""))) != ""


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt by hash to as many tasks as ``n`` rows fill with about TASK_ROWS each."""
    return rows.repartition(max(1, -(-n // TASK_ROWS)), *keys)


def candidates(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, n: int, type_bonus: Mapping[str, float] = TYPE_BONUS, edge_bonus: Mapping[str, float] = EDGE_BONUS) -> DataFrame:
    """(seed, id, score): the first hop's candidates of seeds (seed, id) with one node each, by the best score of the edges that lead there.

    ``n`` is about the number of edges: they are dealt by source, where they meet the seeds, then by target, where they meet the
    nodes and the best score is taken. Nothing is broadcast: nodes are few as a file, but were twice in each task's memory.
    """
    node = lambda c: dealt(nodes.select(F.col("id").alias(c), "type", "desc"), n, c)
    from_ = dealt(seeds.select("seed", F.col("id").alias("src")), n, "src").join(node("src").hint("shuffle_hash"), "src").select("seed", "src", F.col("type").alias("_own"))
    met = dealt(edges.select("src", "dst", F.col("type").alias("edge_type")), n, "src").where("dst <> src").join(from_.hint("shuffle_hash"), "src")
    met = dealt(met.select("seed", "dst", "edge_type", "_own"), n, "dst").join(node("dst").hint("shuffle_hash"), "dst").withColumnRenamed("type", "node_type")
    met = met.withColumn("n_type", F.when(F.col("node_type") == F.col("_own"), 1).otherwise(0))
    return met.groupBy("seed", F.col("dst").alias("id")).agg(F.max(scores(met, type_bonus, edge_bonus)).alias("score"))


def frontier_edges(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, src, dst, edge_type, f) of the edges that leave a frontier (seed, src, f). Edges bucketed by src stay where they are."""
    return edges.select("src", "dst", F.col("type").alias("edge_type")).join(frontier, "src").select("seed", "src", "dst", "edge_type", "f")


class _Hubs:
    """Edges of nodes with many of them, so that a seed needn't meet them all.

    Edges of one source, type, and kind of target (type, and whether it has a description) have one score for a seed, and are
    met in the order of their targets. So of each such group only the first ``keep`` targets can be needed, those that the seed knows and
    those that it can select, with two exceptions, that are looked up: other edges to a node that is met anyway, and
    targets that come early by an edge of one hub and high by a better edge of another, later one.
    """

    group = ("src", "edge_type", "node_type", "told")

    def __init__(self, edges: DataFrame, keep: int, typed, edge_bonus: Mapping[str, float]):
        self.keep, self.bonus = keep, lambda c: _literal_map(edge_bonus, F.col(c), 0.0)
        self.names = Stage(edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HUB * keep).select("src"), "hubs").df
        self.some = not self.names.isEmpty()
        if self.some:
            own = typed(edges.select("src", "dst", F.col("type").alias("edge_type")).join(self.names, "src", "left_semi"))
            place = F.dense_rank().over(W.partitionBy(*self.group).orderBy("dst"))
            self.all = Stage(own.select(*self.group, "dst", place.alias("place")), "hub-edges").df
            self.cut = Stage(self.all.where(F.col("place") == keep + 1).select(*self.group).distinct(), "cut").df

    def first(self, frontier: DataFrame) -> DataFrame:
        """(seed, src, dst, edge_type, f) of each group's first edges, and of those that two cut groups of a frontier share."""
        out = frontier.join(self.all.where(F.col("place") <= self.keep), "src").select("seed", "src", "dst", "edge_type", "f")
        cut = frontier.join(self.cut, "src")
        as_ = lambda df, n: df.select("seed", *(F.col(c).alias(c + n) for c in ("src", "edge_type", "f")), "node_type", "told")
        both = as_(cut, "1").join(as_(cut, "2"), ["seed", "node_type", "told"]).where((F.col("f2") < F.col("f1")) & (self.bonus("edge_type2") < self.bonus("edge_type1")))
        both = Stage(both, "shared").df
        if both.isEmpty():
            return out
        names = ["src1", "edge_type1", "src2", "edge_type2", "node_type", "told"]
        side = lambda n: self.all.select(*(F.col(c).alias(c + n) for c in ("src", "edge_type")), "node_type", "told", "dst")
        met = both.select(*names).distinct().join(side("2"), ["src2", "edge_type2", "node_type", "told"]).join(side("1"), ["src1", "edge_type1", "node_type", "told", "dst"])
        met = met.withColumn("n", F.dense_rank().over(W.partitionBy(*names).orderBy("dst"))).where(F.col("n") <= self.keep).drop("n")
        met = both.join(met, names).select("seed", "dst", F.explode(F.array(*(F.struct(*(F.col(c + n).alias(c) for c in ("src", "edge_type", "f"))) for n in "12"))).alias("e"))
        return out.unionByName(met.select("seed", "e.src", "dst", "e.edge_type", "e.f"))

    def to(self, frontier: DataFrame, targets: DataFrame) -> DataFrame:
        """Edges beyond the first of their groups to ``targets`` (seed, dst, node_type, told)."""
        asked = frontier.join(self.cut.select("src", "node_type", "told").distinct(), "src").join(targets, ["seed", "node_type", "told"])
        rest = self.all.where(F.col("place") > self.keep).select("src", "dst", "edge_type")
        return rest.join(asked.select("seed", "src", "dst", "f"), ["src", "dst"]).select("seed", "src", "dst", "edge_type", "f")


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 2, max_nodes: int = 60, caps: Mapping[str, int] | None = None, type_bonus: Mapping[str, float] = TYPE_BONUS, edge_bonus: Mapping[str, float] = EDGE_BONUS) -> tuple[DataFrame, DataFrame]:
    """Budgeted expansion of all seeds at once: (seed, id, name, type, desc, hop, ord) and (seed, src, dst, type, hop, ord).

    Every hop joins the frontier with the edges. Of the new nodes, each type gets a quota: what its cap leaves, spread
    over the hops left. The best of each type with room come first, rarer types and higher bonuses before others; then
    all others by score; both until the budget of nodes is used up. Edges to known nodes are recorded, and edges to
    nodes that this hop selects. Neighbours are met in the order of the frontier, then of dst and type; repeated edges count once.

    A hop writes two tables to the shared folder, the edges that it met and the nodes that it selected, and reads those of the
    hops before; so a hop's plan is as large as the first one's. Only ids, types and whether there is a description take part in
    the selection; names and descriptions are joined with the selected nodes at the end. Candidates are ranked after they are
    cut to the largest cap of a (seed, type), within each task first. Of nodes with many edges, a seed only meets those that can matter
    (``_Hubs``), so rows grow with seeds and not with seeds times a hub's edges.
    """
    limits = dict(caps if caps is not None else type_caps(max_nodes))
    default_cap = limits.get("*", max_nodes)
    most = max(0, *limits.values(), default_cap)
    about = nodes.select(F.col("id").alias("dst"), F.coalesce("type", F.lit("Unknown")).alias("node_type"), _told(F.col("desc")).alias("told"))
    typed = lambda df: df.join(about, "dst", "left").withColumns({"node_type": F.coalesce("node_type", F.lit("Unknown")), "told": F.coalesce("told", F.lit(False))})

    start = typed(seeds.select("seed", F.col("id").alias("dst")).distinct()).select("seed", F.col("dst").alias("id"), F.col("node_type").alias("type"), F.lit(0).alias("hop"), F.row_number().over(W.partitionBy("seed").orderBy("dst")).alias("ord"))
    known, met_all = Grown(start, "nodes"), None
    hubs = _Hubs(edges, most + max_nodes, typed, edge_bonus) if max_hops > 0 else None
    frontier = known.df
    for hop in range(1, max_hops + 1):
        so_far = known.df
        totals = so_far.groupBy("seed").agg(F.count("*").alias("n_nodes"))
        counts = so_far.groupBy("seed", F.col("type").alias("node_type")).agg(F.count("*").alias("n_type"))
        from_ = frontier.join(totals.where(F.col("n_nodes") < max_nodes), "seed").select("seed", F.col("id").alias("src"), F.col("ord").alias("f"))
        if hubs.some:
            first = Stage(frontier_edges(from_.join(hubs.names, "src", "left_anti"), edges).unionByName(hubs.first(from_.join(hubs.names, "src", "left_semi"))), "first").df
            targets = typed(first.select("seed", "dst").unionByName(so_far.select("seed", F.col("id").alias("dst"))).distinct())
            met = first.unionByName(hubs.to(from_, targets)).withColumn("hop", F.lit(hop))
        else:
            met = frontier_edges(from_, edges).withColumn("hop", F.lit(hop))
        if met_all is None:
            met_all = Grown(met, "met")
            met = met_all.df
        else:
            met = met_all.add(met)
        # one row a candidate before anything is joined to it; the score takes the best of its edges
        one = met.groupBy("seed", "dst").agg(F.max_by("edge_type", _literal_map(edge_bonus, F.col("edge_type"), 0.0)).alias("edge_type"), F.min(F.struct("f", "dst", "edge_type")).alias("met"))
        new = one.join(so_far.select("seed", F.col("id").alias("dst")), ["seed", "dst"], "left_anti")
        new = typed(new).join(counts, ["seed", "node_type"], "left").withColumn("n_type", F.coalesce("n_type", F.lit(0)))
        new = new.withColumn("score", scores(new, type_bonus, edge_bonus)).select("seed", F.col("dst").alias("id"), "node_type", "n_type", "score", "met")
        in_type = W.partitionBy("seed", "node_type")
        cap = _literal_map({k: v for k, v in limits.items() if k != "*"}, F.col("node_type"), default_cap)
        room = cap - F.col("n_type")
        quota = F.when(room > 0, F.least(room, F.greatest(F.lit(1.0), F.ceil(room / (max_hops - hop + 1)).cast("double")))).otherwise(F.lit(0.0))
        ranked = new.withColumn("r", F.row_number().over(in_type.orderBy(F.col("score").desc(), "met"))).where(F.col("r") <= most).where(F.col("r") <= quota)
        ranked = ranked.join(new.groupBy("seed", "node_type").agg(F.min("met").alias("type_met")), ["seed", "node_type"]).join(totals, "seed")
        first = F.col("r") == 1
        key = [F.when(first, 0).otherwise(1), F.when(first, F.col("n_type")), F.when(first, -_literal_map(type_bonus, F.col("node_type"), 0.0)), F.when(first, F.col("type_met")), F.col("score").desc(), F.col("met")]
        picked = ranked.withColumn("s", F.row_number().over(W.partitionBy("seed").orderBy(*key))).where(F.col("s") <= F.lit(max_nodes) - F.col("n_nodes"))
        frontier = known.add(picked.select("seed", "id", F.col("node_type").alias("type"), F.lit(hop).alias("hop"), F.col("s").alias("ord")))
    names = nodes.select(F.col("id").alias("_id"), "name", "desc")
    out_nodes = known.df.withColumn("ord", F.row_number().over(W.partitionBy("seed").orderBy("hop", "ord"))).join(names, F.col("id") == F.col("_id"), "left")
    out_nodes = out_nodes.select("seed", "id", F.coalesce("name", "id").alias("name"), "type", F.coalesce("desc", F.lit("")).alias("desc"), "hop", "ord")
    if met_all is None:
        none = seeds.select("seed", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("").alias("type"), F.lit(0).alias("hop"), F.lit(0).alias("ord"))
        return out_nodes, none.where("false")
    at = known.df.select("seed", F.col("id").alias("dst"), F.col("hop").alias("_hop"), F.col("ord").alias("_s"))
    held = met_all.df.join(at, ["seed", "dst"]).where("_hop <= hop")
    fresh = F.col("_hop") == F.col("hop")
    # an edge counts where it is met first: to a node known before, or to one that the hop selects
    where = F.min(F.struct("hop", F.when(fresh, 1).otherwise(0).alias("group"), F.when(fresh, F.col("_s")).otherwise(0).alias("s"), "f")).alias("at")
    once = held.groupBy("seed", "src", "dst", F.col("edge_type").alias("type")).agg(where)
    out_edges = once.select("seed", "src", "dst", "type", F.col("at.hop").alias("hop"), F.row_number().over(W.partitionBy("seed").orderBy("at", "dst", "src", "type")).alias("ord"))
    return out_nodes, out_edges


def render(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node_count, edge_count, structured_text): one text for each seed's subgraph."""
    tag = F.when(F.trim("desc") != "", F.concat_ws("", F.col("name"), F.lit(" ["), F.col("type"), F.lit(" | "), F.col("desc"), F.lit("]"))).otherwise(F.concat_ws("", F.col("name"), F.lit(" ["), F.col("type"), F.lit("]")))
    ordered = lambda line: F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    n = nodes.groupBy("seed").agg(ordered(tag).alias("nl"), F.count("*").alias("node_count"))
    name = nodes.select("seed", "id", "name")
    named = edges.join(name.select("seed", F.col("id").alias("src"), F.col("name").alias("a")), ["seed", "src"]).join(name.select("seed", F.col("id").alias("dst"), F.col("name").alias("b")), ["seed", "dst"])
    e = named.groupBy("seed").agg(ordered(F.concat_ws("", F.col("a"), F.lit(" -> "), F.col("b"), F.lit(" ("), F.col("type"), F.lit(")"))).alias("el"), F.count("*").alias("edge_count"))
    lines = F.concat(F.array(F.lit("<|HVG_subgraph|>"), F.lit("NODES:")), F.col("nl"), F.array(F.lit(""), F.lit("EDGES:")), F.coalesce("el", F.array().cast("array<string>")))
    return n.join(e, "seed", "left").select("seed", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.array_join(lines, "\n").alias("structured_text"))


def attach_embeddings(nodes: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their vectors, and for each seed how many were found and missing."""
    joined = nodes.join(embeddings.select(F.col("id").alias("_e"), "vec"), F.col("id") == F.col("_e"), "left").drop("_e")
    return joined, joined.groupBy("seed").agg(F.count("vec").alias("found"), F.count_if(F.col("vec").isNull()).alias("missing"))


def counts(edges: DataFrame) -> DataFrame:
    """Edges and distinct nodes of each edge type."""
    ends = edges.select("type", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("type").agg(F.count("*").alias("n_nodes"))
    return edges.groupBy("type").agg(F.count("*").alias("n_edges")).join(ends, "type")


def adjacency(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(src, degree, part, neighbours): sorted neighbours of each node; a node with more than ``most`` has several rows.

    Neighbours of such a hub are dealt to parts of about ``most`` by the hash of their id, so no task holds a whole hub.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    place = F.conv(F.substr(F.md5("dst"), F.lit(1), F.lit(8)), 16, 10).cast("long")
    dealt = edges.join(degree, "src").withColumn("part", place % F.ceil(F.col("degree") / most))
    return dealt.groupBy("src", "degree", "part").agg(F.sort_array(F.collect_list(F.struct("dst", "type"))).alias("neighbours"))
