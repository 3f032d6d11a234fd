"""Architecture graphs as edge tables: elements(id, …), edges(src, dst, …); src depends on dst."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions.lint import blank, broken_rules, names_where
from ashlar.functions.levels import seconds_between
from ashlar.plans.loops import Workspace, cells_joined_in_place
from ashlar.plans.numbering import number_rows
from ashlar.plans.scans import running_sum, scan

# Kinds that need a technology, and names that hint at a shared drawer.
DEPLOYED_KINDS = ["container", "database", "queue"]
SHARED_MODULE = r"(?i)(^|[./_ -])(utils?|common)($|[./_ -])"


# -- diagrams ----------------------------------------------------------------------------------


def lift_graph(elements: DataFrame, rels: DataFrame) -> DataFrame:
    """Relations between elements → relations between their boundaries.

    Self edges are dropped, parallel ones merged with their protocols and a count.
    """
    src = elements.select(F.col("id").alias("src"), F.col("boundary").alias("from"))
    dst = elements.select(F.col("id").alias("dst"), F.col("boundary").alias("to"))
    pairs = rels.groupBy("src", "dst", "protocol").agg(F.count(F.lit(1)).alias("_n"))
    lifted = pairs.join(src, "src").join(dst, "dst").filter(F.col("from") != F.col("to"))
    by_protocol = lifted.groupBy("from", "to", "protocol").agg(F.sum("_n").alias("_n"))
    return by_protocol.groupBy("from", "to").agg(
        F.array_sort(F.collect_list("protocol")).alias("protocols"), F.sum("_n").alias("relations")
    )


def diagram_lint(diagrams: DataFrame, elements: DataFrame, rels: DataFrame) -> DataFrame:
    """One row (diagram, item, rule) per broken drawing rule; item null for the whole diagram.

    diagrams(diagram, legend), elements(diagram, id, kind, name, technology, responsibility, level),
    rels(diagram, id, verb, protocol, mode).
    """
    col = F.col
    per_element = broken_rules(
        elements,
        ["diagram", "id"],
        {
            "no name": blank(col("name")),
            "no technology": col("kind").isin(DEPLOYED_KINDS) & blank(col("technology")),
            "no responsibility": blank(col("responsibility")),
        },
    )
    bare_use = (F.lower(F.trim("verb")) == "uses") & blank(col("protocol"))
    per_rel = broken_rules(
        rels,
        ["diagram", "id"],
        {
            "no verb": blank(col("verb")),
            "no protocol": blank(col("protocol")),
            "uses alone": bare_use,
            "sync or async not marked": col("mode").isNull() | ~col("mode").isin("sync", "async"),
        },
    )
    levels = elements.groupBy("diagram").agg(F.count_distinct("level").alias("_levels"))
    whole = diagrams.join(levels, "diagram", "left")
    item = elements.schema["id"].dataType
    per_diagram = broken_rules(
        whole.withColumn("id", F.lit(None).cast(item)),
        ["diagram", "id"],
        {"mixed levels": col("_levels") > 1, "long legend": F.size(F.split("legend", "\n")) > 3},
    )
    return reduce(DataFrame.unionByName, [per_element, per_rel, per_diagram]).withColumnRenamed("id", "item")


def levels_needed(designs: DataFrame, containers: DataFrame) -> DataFrame:
    """designs(design), containers(design, container, risk) → rows (design, level, container)."""
    per = containers.groupBy("design").agg(
        F.count_distinct("container").alias("_n"),
        F.min_by("container", F.struct(-F.col("risk"), F.col("container"))).alias("_riskiest"),
    )
    none = F.lit(None).cast(containers.schema["container"].dataType)

    def level(n: int, container: Column) -> Column:
        return F.struct(F.lit(n).alias("level"), container.alias("container"))

    rows = F.array(
        level(1, none),
        F.when(F.col("_n") > 1, level(2, none)),
        F.when(F.col("_riskiest").isNotNull(), level(3, F.col("_riskiest"))),
    )
    return designs.join(per, "design", "left").select("design", F.explode(F.array_compact(rows)).alias("_l")).select("design", "_l.*")


# -- loops -------------------------------------------------------------------------------------


def _on_both_sides(edges: DataFrame) -> DataFrame:
    """Edges whose source is entered and whose target is left by some edge."""
    entered = edges.select(F.col("dst").alias("src")).distinct()
    left = edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst")


def _reach_labels(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, f, b): the smallest node that reaches it and the smallest it reaches (itself included).

    Only nodes whose labels fell in the last round send messages.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b"), F.lit(True).alias("fresh"))
    labels, moved = space.state(labels, "labels")
    while moved:
        sender = labels.filter("fresh")
        ahead = sender.select(F.col("node").alias("src"), "f").join(edges, "src").select(F.col("dst").alias("node"), "f")
        behind = sender.select(F.col("node").alias("dst"), "b").join(edges, "dst").select(F.col("src").alias("node"), "b")
        own = labels.select("node", "f", "b", F.col("f").alias("_f"), F.col("b").alias("_b"))
        votes = own.unionByName(ahead, allowMissingColumns=True).unionByName(behind, allowMissingColumns=True)
        lowest = votes.groupBy("node").agg(
            F.min("f").alias("f"), F.min("b").alias("b"), F.max("_f").alias("_f"), F.max("_b").alias("_b")
        )
        fell = (F.col("f") < F.col("_f")) | (F.col("b") < F.col("_b"))
        labels, moved = space.state(lowest.select("node", "f", "b", fell.alias("fresh")), "labels", F.col("fresh"))
    return labels.drop("fresh")


def _chains(edges: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Nodes of one in- and one out-edge, taken out of the graph; None if there are none.

    Gives the edges without them, where an edge stands for each chain, and (node, chain), (chain, u, w): a chain leads
    from u to w, and (node, grp): the nodes of cycles that consist of such nodes only. Every node follows its successors
    by pointer doubling, so a chain or cycle of n nodes takes about log2(n) rounds. On a cycle no node arrives; its nodes
    agree on their least one when a round neither lets a node arrive nor lowers a minimum.
    """
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("succ"), F.lit(None).cast("long").alias("pred")),
        F.struct(F.col("dst").alias("node"), F.lit(None).cast("long").alias("succ"), F.col("src").alias("pred")),
    )
    degrees = edges.select(F.inline(ends)).groupBy("node").agg(
        F.count("pred").alias("_in"), F.count("succ").alias("_out"), F.max("pred").alias("pred"), F.max("succ").alias("succ")
    )
    inner, n = space.state(degrees.filter("_in = 1 AND _out = 1").select("node", "pred", "succ"), "inner")
    if not n:
        return None
    known = inner.select("node").withColumn("_inner", F.lit(True))
    after = known.select(F.col("node").alias("succ"), F.col("_inner").alias("_goes_on"))
    before = known.select(F.col("node").alias("pred"), F.col("_inner").alias("_came"))
    linked = space.keep(inner.join(after, "succ", "left").join(before, "pred", "left").na.fill(False, ["_goes_on", "_came"]))
    start = linked.select(
        "node",
        F.when(F.col("_goes_on"), F.col("succ")).otherwise(F.col("node")).alias("up"),
        F.when(F.col("_goes_on"), F.least("node", "succ")).otherwise(F.col("node")).alias("low"),
        F.col("_goes_on").alias("open"),
        F.lit(True).alias("_moved"),
    )
    rows, moved = space.state(start, "pointers", F.col("open"))
    while moved:
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"), F.col("open").alias("_open"))
        on = rows.filter("open").join(above, "up").select(
            "node", F.col("_up").alias("up"), F.least("low", "_low").alias("low"), F.col("_open").alias("open"),
            (~F.col("_open") | (F.col("_low") < F.col("low"))).alias("_moved"),
        )
        arrived = rows.filter(~F.col("open")).withColumn("_moved", F.lit(False))
        rows, moved = space.state(on.unionByName(arrived), "pointers", F.col("_moved"))
    rows = space.keep(rows.drop("_moved"))
    circles = rows.filter("open").select("node", F.col("low").alias("grp"))
    nodes = rows.filter(~F.col("open")).select("node", F.col("up").alias("chain"))
    heads = linked.filter(~F.col("_came")).join(nodes, "node").select("chain", F.col("pred").alias("u"))
    tails = linked.filter(~F.col("_goes_on")).select(F.col("node").alias("chain"), F.col("succ").alias("w"))
    chains = space.keep(heads.join(tails, "chain"))
    outside = edges.join(known.select(F.col("node").alias("src")), "src", "left_anti").join(
        known.select(F.col("node").alias("dst")), "dst", "left_anti")
    links = chains.filter(F.col("u") != F.col("w")).select(F.col("u").alias("src"), F.col("w").alias("dst"))
    return outside.select("src", "dst").unionByName(links).distinct(), nodes, chains, circles


def _with_chains(members: DataFrame, nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Members (node, grp) and the nodes of chains that lead from a group into itself, or from a node back to it."""
    start = members.select(F.col("node").alias("u"), F.col("grp").alias("_gu"))
    end = members.select(F.col("node").alias("w"), F.col("grp").alias("_gw"))
    closed = chains.join(start, "u", "left").join(end, "w", "left").filter(
        (F.col("u") == F.col("w")) | (F.col("_gu") == F.col("_gw")))
    named = closed.select("chain", "u", F.coalesce("_gu", "u").alias("grp"), F.col("_gu").isNull().alias("_alone"))
    alone = named.filter("_alone").select(F.col("u").alias("node"), "grp").distinct()
    return members.unionByName(nodes.join(named, "chain").select("node", "grp")).unionByName(alone)


def cycle_members(edges: DataFrame, trims: int = 3) -> DataFrame:
    """Nodes on a directed cycle, with grp = the smallest node of their strongly connected group. Nodes are long.

    Each pass takes out loose ends and chains (nodes of one in- and one out-edge), then labels every node with the smallest
    node reaching it (f) and reached by it (b). f = b names a finished group; an edge whose ends differ in f or b lies on
    no cycle. The closure is never built. Chains come back when the groups are known: their nodes lie on a cycle if the
    chain leads from a group into itself. Self loops are cycles of one node; null ends are no edges.
    """
    space = Workspace(edges.sparkSession)
    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    pairs = space.keep(ends.na.drop().distinct())
    loops = pairs.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    live, groups, levels = pairs.filter(F.col("src") != F.col("dst")), [], []
    while True:
        for _ in range(trims):
            live = _on_both_sides(live)
        live, edges_left = space.state(live, "live")
        if not edges_left:
            break
        if contracted := _chains(live, space):
            live, nodes, chains, circles = contracted
            levels.append((nodes, chains))
            groups.append(circles)
            live, edges_left = space.state(live, "live")
            if not edges_left:
                break
        labels = space.keep(_reach_labels(live, space))
        groups.append(labels.filter(F.col("f") == F.col("b")).select("node", F.col("f").alias("grp")))
        open_ = labels.filter(F.col("f") != F.col("b"))
        src = open_.select(F.col("node").alias("src"), F.col("f").alias("_sf"), F.col("b").alias("_sb"))
        dst = open_.select(F.col("node").alias("dst"), F.col("f").alias("_df"), F.col("b").alias("_db"))
        same = (F.col("_sf") == F.col("_df")) & (F.col("_sb") == F.col("_db"))
        live = live.join(src, "src").join(dst, "dst").filter(same).select("src", "dst")
    if not groups:
        return loops.select("node", F.col("node").alias("grp"))
    members = space.keep(reduce(DataFrame.unionByName, groups))
    for nodes, chains in reversed(levels):
        members = space.keep(_with_chains(members, nodes, chains))
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("_size"), F.min("node").alias("_least"))
    looped = loops.withColumn("_loop", F.lit(True))
    grouped = members.join(sizes, "grp").join(looped, "node", "full_outer")
    return grouped.filter((F.col("_size") > 1) | F.col("_loop")).select("node", F.coalesce("_least", "node").alias("grp"))


#: Words of 64 changes in one row of a bitmap; more changes take further rows.
BLAST_WORDS = 8


def _any_bit(names: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(c) != 0 for c in names])


#: Rows of a hop that one task may combine, messages that it may read, and the least number of tasks, all of one grid.
GRID_ROWS, GRID_MESSAGES, GRID_CELLS = 5_000_000, 50_000_000, 32


def _grid(edges: int, senders: int, receivers: int, blocks: int) -> tuple[int, int]:
    """Rows and columns of the grid of cells that moves least in a hop; (1, 1) stands for one message per edge."""
    best = (senders + edges, 1, 1)
    for columns in (2, 4, 8, 16, 32, 64, 128):
        rows = -(-GRID_CELLS // columns)
        while min(edges // rows, receivers) * blocks > GRID_ROWS * columns or edges * blocks > GRID_MESSAGES * rows * columns:
            if receivers * blocks > GRID_ROWS * columns and edges < receivers * rows:
                break
            rows += 1
        best = min(best, (senders * columns + min(edges, receivers * rows), rows, columns))
    return best[1:]


def _messages(front: DataFrame, live: DataFrame, rows: int, columns: int, fresh: Sequence[str]) -> DataFrame:
    """The bits of ``front`` carried over the edges: (node, block, bits), met by OR.

    Senders are dealt over rows of a grid and receivers over columns. An edge lies in one cell; a sender's bits go to the
    cells of its row, where they are combined by receiver. So a hop moves columns × senders + rows × receivers rows and
    not one for each edge.
    """
    if columns == 1:
        joined = front.join(live, "node")
    else:
        conf = front.sparkSession.conf
        least = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions")
        tasks = max(rows * columns, int(least))  # with fewer, Spark would deal both sides again
        row = F.pmod(F.xxhash64("node"), F.lit(rows))
        column = F.pmod(F.xxhash64("_next"), F.lit(columns))
        dealt = live.select("node", "_next", (row * columns + column).alias("cell")).repartition(tasks, "cell")
        copies = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
        front = front.join(live.select("node").distinct(), "node", "left_semi")  # no copies of nodes that nothing depends on
        sent = front.select("*", copies.alias("_c")).withColumn("cell", row * columns + F.col("_c")).drop("_c")
        joined = sent.repartition(tasks, "cell").join(dealt.hint("merge"), ["cell", "node"])  # a broadcast would leave the cells
    return joined.groupBy(F.col("_next").alias("node"), "block").agg(*[F.bit_or(c).alias(c) for c in fresh])


def _blast(edges: DataFrame, seeds: DataFrame, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """(change, ordinal) and (node, hops, word, bits): bit k of word w stands for the change of ordinal 64 w + k.

    A row of the state holds 64 · BLAST_WORDS changes of one node: those that reached it, and those that did so in the last
    round. Only the fresh bits travel along the edges, so a (change, node) pair travels once in all, and bits meet by OR in
    the cells of a grid first (see ``_messages``). Edges to nodes that every change has reached are dropped; without edges
    the rounds end.
    """
    spark = edges.sparkSession
    space = Workspace(spark)
    live = space.keep(edges.select(F.col("src").alias("_next"), F.col("dst").alias("node")).na.drop().distinct())
    numbered = number_rows(seeds.filter("change IS NOT NULL").select("change").distinct(), ["change"], "_no")
    numbered = space.keep(numbered.select("change", (F.col("_no") - 1).alias("ordinal")))
    size = live.agg(F.count(F.lit(1)), F.approx_count_distinct("node"), F.approx_count_distinct("_next")).first()
    changes = numbered.count()
    blocks = -(-changes // (64 * BLAST_WORDS))
    rows, columns = _grid(*size, blocks)
    seen, fresh = [f"_s{i}" for i in range(BLAST_WORDS)], [f"_f{i}" for i in range(BLAST_WORDS)]
    place = F.floor(F.col("ordinal") / 64)
    bit = F.expr("shiftleft(1L, cast(ordinal % 64 AS int))")
    zero = F.lit(0).cast("long")

    def word(i: int) -> Column:
        return F.col("block") * BLAST_WORDS + i

    whole, rest = changes // 64, F.lit((1 << changes % 64) - 1).cast("long")
    masks = [F.when(word(i) < whole, F.lit(-1).cast("long")).when(word(i) == whole, rest).otherwise(zero) for i in range(BLAST_WORDS)]
    is_full = reduce(Column.__and__, [F.col(s) == m for s, m in zip(seen, masks, strict=True)])
    first = (
        seeds.select("change", "node").filter("node IS NOT NULL").join(numbered, "change")
        .groupBy("node", F.floor(place / BLAST_WORDS).alias("block"))
        .agg(*[F.bit_or(F.when(place % BLAST_WORDS == i, bit).otherwise(zero)).alias(c) for i, c in enumerate(fresh)])
    )
    state = first.select("node", "block", *[F.col(f).alias(s) for f, s in zip(fresh, seen, strict=True)], *fresh)
    state, count = space.counted(state, "reached", moved=_any_bit(fresh), full=is_full)
    words = F.array(*[F.struct(word(i).alias("word"), F.col(c).alias("bits")) for i, c in enumerate(fresh)])
    hop, left, full = 0, size[0], 0
    while count["moved"] and left and (depth is None or hop < depth):
        hop += 1
        front = state.filter(_any_bit(fresh)).select("node", "block", *fresh)
        sent = _messages(front, live, rows, columns, fresh)
        met = state.select("node", "block", *seen).join(sent, ["node", "block"], "full_outer")
        had, got = [F.coalesce(s, zero) for s in seen], [F.coalesce(f, zero) for f in fresh]
        news = [g.bitwiseAND(F.bitwise_not(h)).alias(f) for f, g, h in zip(fresh, got, had, strict=True)]
        known = [g.bitwiseOR(h).alias(s) for s, g, h in zip(seen, got, had, strict=True)]
        with cells_joined_in_place(spark):
            state, count = space.counted(met.select("node", "block", *known, *news), "reached", moved=_any_bit(fresh), full=is_full)
        space.part(state.filter(_any_bit(fresh)).select("node", F.inline(words)).filter("bits <> 0"), "hits", "hops", hop)
        if count["full"] > full:
            full = count["full"]
            done = state.filter(is_full).groupBy(F.col("node").alias("_next")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == blocks)
            live, left = space.state(live.join(done, "_next", "left_anti"), "live")
    node = edges.schema["src"].dataType.simpleString()
    if not hop:
        return numbered, state.select("node", F.lit(0).alias("hops"), F.inline(words)).filter("false")
    hits = space.parts(spark, "hits", f"node {node}, word BIGINT, bits BIGINT, hops INT")
    return numbered, hits.select("node", "hops", "word", "bits")


def _changes_of(numbered: DataFrame, bits: DataFrame) -> DataFrame:
    """Words of bits as one row per change."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(F.col("bits"), k) == 1)
    listed = bits.withColumn("_k", F.explode(places)).withColumn("ordinal", F.col("word") * 64 + F.col("_k"))
    return listed.drop("_k", "word", "bits").join(numbered, "ordinal")


def blast_bitmaps(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """seeds(change, node) → (node, hops, word, bits, changes): everything that depends on what a change touches.

    The change whose rank among all changes (from 0, in order) is 64 · word + k reaches the node by ``hops`` edges at least
    if bit k is set; ``changes`` counts the set bits. hops is the least over the change's nodes, which are left out
    themselves. Rounds go on until nothing new is reached, or to ``depth`` hops if that is asked for. Null nodes and
    changes take no part; an empty table gives an empty one.
    """
    return _blast(edges, seeds, depth)[1].withColumn("changes", F.bit_count("bits"))


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """The same with one row (change, node, hops) for each change and node: as many rows as that makes."""
    numbered, bits = _blast(edges, seeds, depth)
    return _changes_of(numbered, bits).select("change", "node", "hops")


def blast_sizes(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """The number of nodes that each change reaches, by hops: (change, hops, nodes)."""
    numbered, bits = _blast(edges, seeds, depth)
    by_word = bits.groupBy("hops", "word").agg(*[F.sum(F.getbit("bits", F.lit(k)).cast("long")).alias(f"_{k}") for k in range(64)])
    counts = F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_{k}").alias("nodes")) for k in range(64)])
    listed = by_word.select("hops", "word", F.inline(counts)).filter("nodes > 0")
    return listed.withColumn("ordinal", F.col("word") * 64 + F.col("_k")).join(numbered, "ordinal").select("change", "hops", "nodes")


def _roots(parents: DataFrame, space: Workspace) -> DataFrame:
    """parents(node, up) with up <= node, followed to the end by pointer jumping."""
    parents, moved = space.state(parents, "parents")
    while moved:
        above = parents.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
        jumped = parents.join(above, F.col("up") == F.col("_n"))
        higher = (F.col("_up") < F.col("up")).alias("_moved")
        parents, moved = space.state(jumped.select("node", F.col("_up").alias("up"), higher), "parents", F.col("_moved"))
        parents = parents.select("node", "up")
    return parents


def failure_domains(edges: DataFrame) -> DataFrame:
    """(node, domain): connected component of the undirected graph, named by its smallest node.

    Every round points each node at its smallest neighbour, follows the pointers to their ends and
    contracts the edges onto those ends. The edge table shrinks fast, and the smallest node of a
    component is never contracted away. Minima combine on the map side, so a node with very many
    edges costs no task more than its share.
    """
    space = Workspace(edges.sparkSession)
    pairs = space.keep(edges.select("src", "dst").distinct())
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node")))
    domains = ends.distinct().withColumn("domain", F.col("node"))
    live, edges_left = pairs.filter(F.col("src") != F.col("dst")), 1
    while edges_left:
        sides = F.array(
            F.struct(F.col("src").alias("node"), F.least("src", "dst").alias("up")),
            F.struct(F.col("dst").alias("node"), F.least("src", "dst").alias("up")),
        )
        parents = live.select(F.inline(sides)).groupBy("node").agg(F.min("up").alias("up"))
        roots = space.keep(_roots(parents, space))
        src = roots.select(F.col("node").alias("src"), F.col("up").alias("_s"))
        dst = roots.select(F.col("node").alias("dst"), F.col("up").alias("_d"))
        contracted = live.join(src, "src").join(dst, "dst").filter(F.col("_s") != F.col("_d"))
        low, high = F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst")
        live, edges_left = space.state(contracted.select(low, high).distinct(), "live")
        named = roots.select(F.col("node").alias("domain"), F.col("up").alias("_up"))
        domains = domains.join(named, "domain", "left").select("node", F.coalesce("_up", "domain").alias("domain"))
    return domains


# -- rules on edges and accesses ---------------------------------------------------------------


def direction_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """layers(node, rank), 0 = domain core: edges from an inner to an outer layer."""
    src = layers.select(F.col("node").alias("src"), F.col("rank").alias("src_rank"))
    dst = layers.select(F.col("node").alias("dst"), F.col("rank").alias("dst_rank"))
    inward = edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst")
    return inward.filter(F.col("src_rank") < F.col("dst_rank")).withColumn("core", F.col("src_rank") == 0)


def foreign_table_access(access: DataFrame, owners: DataFrame) -> DataFrame:
    """access(service, table), owners(table, owner): services that touch tables of others, with the count."""
    counts = access.groupBy("service", "table").agg(F.count(F.lit(1)).alias("touches"))
    return counts.join(owners, "table").filter(F.col("service") != F.col("owner"))


def shared_tables(writes: DataFrame) -> DataFrame:
    """writes(service, table): tables with several writing services."""
    return writes.groupBy("table").agg(F.count_distinct("service").alias("writers")).filter(F.col("writers") > 1)


def undeclared_dependencies(deps: DataFrame, decisions: DataFrame) -> DataFrame:
    """deps(change, dep) without decisions(dep, num) → stubs (num, dep, first_change) with the next numbers."""
    # One row per dependency before the join, so a dependency of very many changes is no hot key.
    seen = deps.groupBy("dep").agg(F.min("change").alias("first_change"))
    missing = seen.join(decisions.select("dep").distinct(), "dep", "left_anti")
    highest = decisions.select(F.coalesce(F.max("num"), F.lit(0)).alias("_top")).scalar()
    numbered = number_rows(missing, ["dep"], "_n")
    return numbered.select((F.col("_n") + highest).alias("num"), "dep", "first_change")


def contract_diff(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """v1, v2 (contract, field, type, required) → changed fields with kind and breaking flag."""
    key = ["contract", "field"]
    old = v1.select(*key, F.col("type").alias("old_type"), F.col("required").alias("_old_req"), F.lit(True).alias("_old"))
    new = v2.select(*key, F.col("type").alias("new_type"), F.col("required").alias("_new_req"), F.lit(True).alias("_new"))
    tightened = F.col("_new_req") & ~F.coalesce("_old_req", F.lit(False))
    kind = (
        F.when(F.col("_new").isNull(), "removed")
        .when(F.col("_old").isNull(), "added")
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "type changed")
        .when(tightened, "made required")
    )
    breaking = F.col("kind").isin("removed", "type changed", "made required") | tightened
    diff = old.join(new, key, "full_outer").withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return diff.select(*key, "old_type", "new_type", "kind", F.coalesce(breaking, F.lit(False)).alias("breaking"))


def call_policy_gaps(calls: DataFrame) -> DataFrame:
    """calls(call, timeout_ms, retry, on_failure, breaker, is_write, idempotency_key) → missing items per call."""
    missing = names_where(
        {
            "timeout": F.col("timeout_ms").isNull(),
            "retry": blank(F.col("retry")),
            "failure behaviour": blank(F.col("on_failure")),
            "circuit breaker": ~F.coalesce("breaker", F.lit(False)),
            "idempotency key": F.col("is_write") & blank(F.col("idempotency_key")),
        }
    )
    return calls.select("call", missing.alias("missing")).filter(F.size("missing") > 0)


def fan_out(edges: DataFrame, high: int) -> DataFrame:
    """edges(src, dst, mode) → in, out and synchronous out degree per node, and the high flag."""
    one, zero = F.lit(1), F.lit(0)
    ends = F.array(
        F.struct(F.col("src").alias("node"), zero.alias("i"), one.alias("o"), (F.col("mode") == "sync").cast("int").alias("s")),
        F.struct(F.col("dst").alias("node"), one.alias("i"), zero.alias("o"), zero.alias("s")),
    )
    degrees = edges.select(F.inline(ends)).groupBy("node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("s").alias("sync_out")
    )
    return degrees.withColumn("high", F.col("sync_out") > high)


def shared_module_growth(imports: DataFrame, name_pattern: str = SHARED_MODULE) -> DataFrame:
    """imports(module, importer, period): shared-drawer modules in periods with more importers than before."""
    counts = (
        imports.filter(F.col("module").rlike(name_pattern))
        .groupBy("module", "period")
        .agg(F.count_distinct("importer").alias("importers"))
    )
    w = Window.partitionBy("module").orderBy("period")
    grown = counts.withColumn("growth", F.col("importers") - F.lag("importers").over(w))
    return grown.filter(F.col("growth") > 0)


def same_change_check(touches: DataFrame) -> DataFrame:
    """touches(change, model, diagram): change sets that touched a described element but no diagram."""
    sides = touches.groupBy("change").agg(F.bool_or("model").alias("_m"), F.bool_or("diagram").alias("_d"))
    return sides.filter(F.col("_m") & ~F.coalesce("_d", F.lit(False))).select("change")


# -- histories ---------------------------------------------------------------------------------


def saga_reconcile(commands: DataFrame, steps: DataFrame, limit_s: float) -> DataFrame:
    """commands(key, ts) against the first of steps(key, ts) not before it: complete, missing step, late step.

    Steps before the command, or without one, answer nothing: the first of them is a row of its own, orphan step.
    """
    sent = commands.groupBy("key").agg(F.min("ts").alias("sent"))
    dated = steps.select("key", "ts").distinct().join(sent, "key", "left")
    answers = F.col("sent").isNotNull() & (F.col("ts") >= F.col("sent"))
    done = dated.filter(answers).groupBy("key").agg(F.min("ts").alias("done"))
    orphans = dated.filter(~answers).groupBy("key").agg(F.min("ts").alias("done"))
    state = (
        F.when(F.col("done").isNull(), "missing step")
        .when(seconds_between(F.col("sent"), F.col("done")) > limit_s, "late step")
        .otherwise("complete")
    )
    rows = sent.join(done, "key", "left").withColumn("state", state)
    alone = orphans.withColumns({"sent": F.lit(None).cast(sent.schema["sent"].dataType), "state": F.lit("orphan step")})
    return rows.unionByName(alone)


def replay_as_of(events: DataFrame, at: Column) -> DataFrame:
    """events(entity, ts, seq, status, amount) up to ``at`` → last status, event count, balance per entity."""
    return events.filter(F.col("ts") <= at).groupBy("entity").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.count(F.lit(1)).alias("events"),
        F.sum("amount").alias("balance"),
    )


def replay_running(events: DataFrame, unit: str = "day") -> DataFrame:
    """events(entity, ts, seq, amount, …) plus the balance and event count after each event."""
    chunk = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    carries = {"balance": running_sum(F.col("amount")), "events": running_sum(F.lit(1).cast("bigint"))}
    return scan(events, ["entity"], ["ts", "seq"], chunk, carries, measured=True)


def erase_subjects(history: DataFrame, subjects: DataFrame, key: str, blank_out: Sequence[str] = ()) -> DataFrame:
    """History without the subjects' rows, or with ``blank_out`` nulled in them."""
    listed = subjects.select(key).distinct()
    if not blank_out:
        return history.join(listed, key, "left_anti")
    marked = history.join(listed.withColumn("_hit", F.lit(True)), key, "left")
    types = {f.name: f.dataType for f in history.schema.fields}
    nulled = {c: F.when(F.col("_hit"), F.lit(None).cast(types[c])).otherwise(F.col(c)) for c in blank_out}
    return marked.withColumns(nulled).select(*history.columns)


def erase_proof(before: DataFrame, after: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """One row: rows before and after, subject rows left, and rows of others that changed (both must be 0)."""
    listed = subjects.select(key).distinct()
    kept = before.join(listed, key, "left_anti")
    columns = before.columns
    tagged = kept.select(*columns, F.lit(1).alias("_d")).unionByName(
        after.join(listed, key, "left_anti").select(*columns, F.lit(-1).alias("_d"))
    )
    changed = tagged.groupBy(*columns).agg(F.sum("_d").alias("_d")).agg(F.count_if(F.col("_d") != 0).alias("n"))
    left = after.join(listed, key, "left_semi")
    return before.agg(F.count(F.lit(1)).alias("rows_before")).select(
        "rows_before",
        after.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows_after"),
        left.agg(F.count(F.lit(1)).alias("n")).scalar().alias("subject_rows_left"),
        changed.scalar().alias("other_rows_changed"),
    )


def version_mix(events: DataFrame, unit: str) -> DataFrame:
    """events(topic, ts, version) → per topic, period and version: rows, first and last time."""
    period = F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return events.groupBy("topic", period.alias("period"), "version").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
