"""Node and edge tables, degrees, k-hop candidates, proximity, components, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.lineage import cut_lineage, stored
from ..plans.prefix import hash_chunk, rank_within, time_chunk
from .threads import with_parent


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != C.DELETED)


def hetero_edges(df: DataFrame) -> DataFrame:
    """``posted`` author to comment, ``in_response_to`` parent to comment, ``participated_in`` author to community."""
    rows = with_parent(df)
    posted = rows.where(_known("author")).select(F.col("author").alias("src"), F.col("id").alias("dst"), F.lit("posted").alias("edge_type"))
    present = rows.select(F.col("id").alias("src")).distinct()
    replied = rows.select(F.col("pid").alias("src"), F.col("id").alias("dst"), F.lit("in_response_to").alias("edge_type")).join(
        present, "src", "left_semi")
    took = rows.where(_known("author") & F.col("subreddit").isNotNull()).select(
        F.col("author").alias("src"), F.col("subreddit").alias("dst"), F.lit("participated_in").alias("edge_type")).distinct()
    return posted.unionByName(replied).unionByName(took)


def temporal_edges(df: DataFrame, label: str = "is_hate") -> DataFrame:
    """Parent to child reply edges (0) and submission to root comment edges (1) with their attributes."""
    rows = with_parent(df)
    attrs = F.struct(
        (F.col(label) == 1).alias("is_hate"), C.hash_bucket(F.col("subreddit")).alias("bucket"),
        F.col("score").alias("score"), C.text_length(F.col("body")).alias("text_length")).alias("attrs")
    base = rows.select("id", "pid", "link_id", F.col("created_utc").alias("ts"), attrs)
    present = rows.select(F.col("id").alias("pid")).distinct()
    reply = base.join(present, "pid", "left_semi").select(
        F.col("pid").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("edge_type"), "attrs", "ts")
    root = base.where("pid is null and link_id is not null").select(
        F.col("link_id").alias("src"), F.col("id").alias("dst"), F.lit(1).alias("edge_type"), "attrs", "ts")
    return reply.unionByName(root)


def temporal_nodes(df: DataFrame) -> DataFrame:
    rows = with_parent(df)
    comments = rows.select(F.col("id").alias("node")).distinct().withColumn("node_type", F.lit("comment"))
    posts = rows.where("link_id is not null").select(F.col("link_id").alias("node")).distinct()
    return comments.unionByName(posts.withColumn("node_type", F.lit("submission")))


def user_comment_graph(df: DataFrame, users: bool = True) -> DataFrame:
    """Undirected edges in both directions: authored and reply; without users only replies."""
    rows = with_parent(df)
    key = lambda c: F.concat(F.lit("comment_"), F.col(c))
    present = rows.select(F.col("id").alias("pid")).distinct()
    one = rows.where("pid is not null").join(present, "pid", "left_semi").select(
        key("pid").alias("src"), key("id").alias("dst"), F.lit("reply").alias("edge_type"))
    if users:
        authored = rows.where(F.col("author").isNotNull()).select(
            F.concat(F.lit("user_"), "author").alias("src"), key("id").alias("dst"), F.lit("authored").alias("edge_type"))
        one = one.unionByName(authored)
    # both directions in one pass over the rows
    return one.select(F.explode(F.array(
        F.struct("src", "dst", "edge_type"),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))).alias("e")).select("e.*").distinct()


def snapshot_edges(df: DataFrame, hours: int = 1) -> DataFrame:
    """Per time bin: author to comment and comment to known parent, weight 1."""
    rows = with_parent(df)
    step = hours * 3600
    rows = rows.withColumn("bin", (F.floor(F.col("created_utc") / step) * step).cast("bigint"))
    key = lambda c: F.concat(F.lit("comment_"), F.col(c))
    wrote = rows.select("bin", F.concat(F.lit("author_"), "author").alias("src"), key("id").alias("dst"), F.lit(1.0).alias("weight"))
    present = rows.select(F.col("id").alias("pid")).distinct()
    replied = rows.join(present, "pid", "left_semi").select(
        "bin", key("id").alias("src"), key("pid").alias("dst"), F.lit(1.0).alias("weight"))
    return wrote.unionByName(replied)


def comment_features(df: DataFrame, label: str = "is_hate") -> DataFrame:
    """Per comment: length, tokens, score, label and whether it is a root."""
    rows = with_parent(df)
    return rows.select(
        "id", C.text_length(F.col("body")).alias("text_length"), C.token_count(F.col("body")).alias("token_count"),
        "score", F.coalesce((F.col(label) == 1), F.lit(False)).alias("is_hate"), F.col("pid").isNull().alias("is_root"))


def submission_node_features(df: DataFrame, ordinal: str, vectors: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """Submission nodes in the columns of :func:`node_features`: numbers of their comments, their first comment's community,
    and, if given, the mean of their comments' vectors (one sum per dimension, so it combines before the shuffle)."""
    rows = with_parent(df).where("link_id is not null").withColumn("_len", C.text_length(F.col("body")).cast("double"))
    is2, is1 = F.col(ordinal) == 2, F.col(ordinal) == 1
    n = F.count("*")
    aggs = [
        n.cast("double").alias("u_posts"), C.ratio(F.count_if(is2), n).alias("u_hate"), C.ratio(F.count_if(is1), n).alias("u_offensive"),
        F.lit(0.0).alias("u_gap_hours"), F.avg("_len").alias("u_length"), F.min_by("subreddit", F.struct("created_utc", "id")).alias("subreddit"),
        F.max(F.when(is2, 1.0).otherwise(0.0)).alias("c_hate"), F.avg("_len").alias("c_length")]
    if vectors is not None:
        rows = rows.join(vectors.select("id", F.col("embedding").alias("_v")), "id", "left")
        aggs.append(F.array(*[F.avg(F.get("_v", i).cast("double")) for i in range(dim)]).alias("_mean"))
    diversity = rows.groupBy("link_id").agg(F.count_distinct("subreddit").cast("double").alias("u_diversity"))
    community = rows.groupBy("subreddit").agg(
        n.cast("double").alias("s_posts"), C.ratio(F.count_if(is2), n).alias("s_hate"), C.ratio(F.count_if(is1), n).alias("s_offensive"))
    out = rows.groupBy("link_id").agg(*aggs).join(diversity, "link_id").join(community, "subreddit", "left")
    cols = [F.col("link_id").alias("id"), "u_posts", "u_hate", "u_offensive", "u_diversity", "u_gap_hours", "u_length",
            F.coalesce("s_posts", F.lit(1.0)).alias("s_posts"), F.coalesce("s_hate", F.lit(0.0)).alias("s_hate"),
            F.coalesce("s_offensive", F.lit(0.0)).alias("s_offensive"), "c_hate", "c_length", F.lit(0.0).alias("is_comment"), F.lit(1.0).alias("is_submission")]
    if vectors is not None:
        cols.append(F.when(F.col("_mean")[0].isNotNull(), F.col("_mean")).alias("vector"))
    return out.select(*cols)


def node_features(df: DataFrame, ordinal: str, vectors: DataFrame | None = None) -> DataFrame:
    """Comment nodes with 8 author numbers, 3 community numbers, node type and, if given, a vector.

    Comments without a known author get the defaults (1, 0, 0, 1, 0, length, hate, length).
    """
    rows = with_parent(df).withColumn("_len", C.text_length(F.col("body")).cast("double"))
    is2, is1 = F.col(ordinal) == 2, F.col(ordinal) == 1
    n = F.count("*")
    gap = C.ratio(F.max("created_utc") - F.min("created_utc"), F.count("created_utc") - 1) / 3600.0
    user = rows.where(_known("author")).groupBy("author").agg(
        n.cast("double").alias("u_posts"), C.ratio(F.count_if(is2), n).alias("u_hate"), C.ratio(F.count_if(is1), n).alias("u_offensive"),
        gap.alias("u_gap_hours"), F.avg("_len").alias("u_length"))
    diversity = rows.where(_known("author")).groupBy("author").agg(F.count_distinct("subreddit").cast("double").alias("u_diversity"))
    user = user.join(diversity, "author")
    community = rows.groupBy("subreddit").agg(
        n.cast("double").alias("s_posts"), C.ratio(F.count_if(is2), n).alias("s_hate"), C.ratio(F.count_if(is1), n).alias("s_offensive"))
    out = rows.join(user, "author", "left").join(community, "subreddit", "left")
    zero, one = F.lit(0.0), F.lit(1.0)
    picked = {
        "u_posts": one, "u_hate": zero, "u_offensive": zero, "u_diversity": one, "u_gap_hours": zero, "u_length": F.col("_len"),
        "s_posts": one, "s_hate": zero, "s_offensive": zero}
    cols = ["id", *[F.coalesce(F.col(c), d).alias(c) for c, d in picked.items()],
            F.when(is2, 1.0).otherwise(0.0).alias("c_hate"), F.col("_len").alias("c_length"),
            F.lit(1.0).alias("is_comment"), F.lit(0.0).alias("is_submission")]
    if vectors is not None:
        out = out.join(vectors.select("id", F.col("embedding").alias("vector")), "id", "left")
        cols.append("vector")
    return out.select(*cols)


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)`` of an undirected edge list that names each edge once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def one_way(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    e = one_way(edges)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def top_subgraph(edges: DataFrame, k: int = 100) -> DataFrame:
    """Edges among the ``k`` nodes of highest degree."""
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(k).select("node")
    return edges.join(top, F.col("src") == F.col("node"), "left_semi").join(top, F.col("dst") == F.col("node"), "left_semi")


def reach(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """``(source, node, hops)``: shortest hop count from each source, up to ``max_hops``.

    One frontier join per hop; nodes already reached are removed before the next.
    ``edges`` hold both directions.
    """
    step = cut_lineage(edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).distinct())
    seen = cut_lineage(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")).distinct())
    frontier = seen
    for hop in range(1, max_hops + 1):
        found = frontier.join(step, "node").select("source", F.col("_next").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def khop_candidates(
    edges: DataFrame, sources: DataFrame, k: int = 2, cap: int | None = None, min_candidates: int = 1, seed: int = 42
) -> DataFrame:
    """``(source, node, hops)`` within ``k`` hops, the source left out.

    ``cap`` keeps a repeatable choice per source (off by default); sources with
    fewer than ``min_candidates`` are dropped.
    """
    out = reach(edges, sources, k).where("hops > 0")
    if min_candidates > 1:
        enough = out.groupBy("source").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_candidates)
        out = out.join(enough, "source", "left_semi")
    if cap is None:
        return out
    digest = F.md5(F.concat(F.lit(f"{seed}|"), "source", F.lit("|"), "node"))
    ranked = rank_within(out.withColumn("_d", digest), ["source"], ["_d", "node"], "_rank", hash_chunk("_d"))
    return ranked.where(F.col("_rank") <= cap).drop("_d", "_rank")


def hate_prone_users(df: DataFrame, k: int = 100, label: str = "is_hate") -> DataFrame:
    """The ``k`` users with the highest hate ratio."""
    f = df.where(_known("author")).groupBy("author").agg(C.ratio(F.count_if(F.col(label) == 1), F.count("*")).alias("hate_ratio"))
    return f.orderBy(F.desc("hate_ratio"), "author").limit(k)


def proximity(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None, unreachable: float = 0.1) -> DataFrame:
    """``1 / (1 + shortest path)`` for each ``(source, node)`` pair, ``unreachable`` without a path.

    The search goes on until every pair is answered or no frontier is left; a source all of whose pairs are
    answered is searched no further.  ``max_hops`` ends it earlier.
    """
    step = cut_lineage(edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).distinct())
    asked = cut_lineage(pairs.select("source", "node").distinct())
    seen = frontier = cut_lineage(asked.select("source", F.col("source").alias("node")).distinct())
    answers = asked.where("source = node").select("source", "node", F.lit(0).alias("hops"))
    asked = cut_lineage(asked.where("source <> node"))
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        frontier = frontier.join(asked.select("source").distinct(), "source", "left_semi")
        found = frontier.join(step, "node").select("source", F.col("_next").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, ["source", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        answers = answers.unionByName(asked.join(frontier, ["source", "node"], "left_semi").withColumn("hops", F.lit(hop)))
        asked = cut_lineage(asked.join(frontier, ["source", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    near = answers.select("source", "node", (1.0 / (1.0 + F.col("hops"))).alias("_p"))
    return pairs.join(near, ["source", "node"], "left").select(
        *pairs.columns, F.coalesce("_p", F.lit(unreachable)).alias("proximity"))


def hops_from(edges: DataFrame, sources: DataFrame, nodes: DataFrame | None = None, max_hops: int | None = None) -> tuple[DataFrame, list]:
    """All sources searched at once: ``(node, hop, masks)`` and the sources in the order of the masks' bits.

    ``masks`` has a bit for every source that reaches the node in just ``hop`` steps, in words of 64.  A hop hands the
    masks along the edges and joins them by bitwise or, so a frontier has one row a node however many sources there are.
    The sources are a query set of a stated size.  With ``nodes`` the search ends when all of these are reached by all.
    """
    names = sorted(r["node"] for r in sources.select("node").where("node is not null").distinct().collect())
    words = [f"_m{i}" for i in range(-(-len(names) // 64))]
    spark = edges.sparkSession
    bit = lambda i: 1 << (i % 64) if i % 64 < 63 else -(1 << 63)
    start = [(n, *[bit(i) if i // 64 == w else 0 for w in range(len(words))]) for i, n in enumerate(names)]
    frontier = spark.createDataFrame(start, ", ".join(["node string", *[f"{w} bigint" for w in words]]))
    full = [-1 if len(names) - 64 * w >= 64 else (1 << (len(names) - 64 * w)) - 1 for w in range(len(words))]
    step = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).distinct(), "steps")
    found = seen = frontier.withColumn("hop", F.lit(0))
    hop = 0
    joined = [F.bit_or(w).alias(w) for w in words]
    while words and (max_hops is None or hop < max_hops):
        hop += 1
        sent = frontier.join(step, "node").groupBy(F.col("_next").alias("node")).agg(*joined)
        before = seen.groupBy("node").agg(*[F.bit_or(w).alias(f"_o{w}") for w in words])
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_o{w}", F.lit(0).cast("bigint")))).alias(w) for w in words]
        new = sent.join(before, "node", "left").select("node", *fresh).where(" or ".join(f"{w} <> 0" for w in words))
        frontier = stored(new, "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("hop", F.lit(hop)))
        seen = stored(found.groupBy("node").agg(*joined), "seen")
        if nodes is not None:
            whole = seen.where(" and ".join(f"{w} = {f}" for w, f in zip(words, full, strict=True)))
            if nodes.join(whole, "node", "left_anti").isEmpty():
                break
    return found.select("node", "hop", F.array(*words).alias("masks") if words else F.expr("cast(array() as array<bigint>)").alias("masks")), names


def proximity_to_all(edges: DataFrame, sources: DataFrame, nodes: DataFrame, max_hops: int | None = None, unreachable: float = 0.1) -> DataFrame:
    """``(source, node, proximity)`` of every source with every other of ``nodes``, as :func:`proximity` has it.

    Pairs are first written when they are answered: a node's masks become its rows.
    """
    found, names = hops_from(edges, sources, nodes, max_hops)
    asked = nodes.select("node").where("node is not null").distinct()
    hits = found.join(asked, "node").groupBy("node").agg(F.collect_list(F.struct("hop", "masks")).alias("h"))  # one entry a hop
    rows = asked.join(hits, "node", "left")
    number = F.sequence(F.lit(0), F.lit(len(names) - 1)) if names else F.expr("cast(array() as array<int>)")
    named = F.array(*[F.lit(n) for n in names]) if names else F.expr("cast(array() as array<string>)")
    hop = F.expr("array_min(transform(filter(h, x -> (shiftright(x.masks[cast(i div 64 as int)], cast(i % 64 as int)) & 1L) = 1L), x -> x.hop))")
    out = rows.select("node", "h", F.explode(number).alias("i")).select(F.get(named, F.col("i")).alias("source"), "node", hop.alias("hop"))
    return out.where("source <> node").select("source", "node", F.coalesce(1.0 / (1.0 + F.col("hop")), F.lit(unreachable)).alias("proximity"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, component)``: the smallest node reachable over undirected edges.

    Alternating large-star and small-star rounds rewire every node towards the
    smallest node it knows, so long paths shrink fast; hubs are handled by the
    combining ``min`` and never listed.
    """
    every = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select("node"))
    state = cut_lineage(one_way(edges).select(F.col("dst").alias("u"), F.col("src").alias("v")))  # v < u
    before = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        two = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        state = cut_lineage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    label = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return every.distinct().join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(node, triangles)``; edges point to the end of higher degree, so no node has many outgoing ones."""
    e = one_way(edges)
    d = degrees(e)
    rank = lambda n: F.struct(F.col(f"_{n}").alias("d"), F.col(n).alias("n"))
    both = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("_src")), "src").join(
        d.select(F.col("node").alias("dst"), F.col("degree").alias("_dst")), "dst")
    up = rank("src") < rank("dst")
    out = cut_lineage(both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    path = out.join(out.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    closed = path.join(out.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi")
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def connectivity(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, mean clustering coefficient, components and size of the largest."""
    e = cut_lineage(one_way(edges))
    comp = components(e, nodes)
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    summary = sizes.agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.max("n").alias("largest"))
    local = degrees(e).join(triangles(e), "node", "left")
    pairs = F.col("degree") * (F.col("degree") - 1.0)
    total = local.agg(F.sum(F.when(F.col("degree") > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / pairs).otherwise(0.0)).alias("c"))
    return summary.select(
        F.coalesce("nodes", F.lit(0)).alias("nodes"), F.lit(e.count()).cast("bigint").alias("edges"),
        C.ratio(total.scalar(), F.col("nodes")).alias("clustering"), "components", F.coalesce("largest", F.lit(0)).alias("largest"))


def propagate_features(edges: DataFrame, features: DataFrame, names: list[str], rounds: int = 1) -> DataFrame:
    """Symmetrically normalised neighbour sums with a self-loop, ``rounds`` times.

    All features move in one join and one combining aggregate per round.
    """
    e = cut_lineage(both_ways(edges))  # read in every round
    deg = e.groupBy(F.col("src").alias("node")).agg((F.count("*") + 1).alias("deg"))
    x = features.select("node", *[F.col(n).cast("double").alias(n) for n in names]).join(deg, "node", "left")
    state = x.select("node", F.coalesce("deg", F.lit(1)).alias("deg"), *names)
    for i in range(rounds):
        scaled = state.select("node", "deg", *[(F.col(n) / F.sqrt("deg")).alias(n) for n in names])
        sent = e.join(scaled.select(F.col("node").alias("src"), *names), "src").select(F.col("dst").alias("node"), *names)
        own = scaled.select("node", *names)
        total = sent.unionByName(own).groupBy("node").agg(*[F.sum(n).alias(n) for n in names])
        state = scaled.select("node", "deg").join(total, "node").select(
            "node", "deg", *[(F.col(n) / F.sqrt("deg")).alias(n) for n in names])
        if i + 1 < rounds:
            state = cut_lineage(state)
    return state.select("node", *names)


def pair_similarity(pairs: DataFrame, vectors: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Cosine and ``1/(1+distance)`` of the vectors of each ``(source, node)`` pair.

    ``features`` names hate-related columns of ``vectors`` compared by cosine as well.
    """
    more = features or []
    left = vectors.select(F.col("node").alias("source"), F.col("embedding").alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in more])
    right = vectors.select("node", F.col("embedding").alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in more])
    out = pairs.join(left, "source", "left").join(right, "node", "left")
    cols = [C.cosine(F.col("_a"), F.col("_b")).alias("cosine"), C.euclid_similarity(F.col("_a"), F.col("_b")).alias("euclid")]
    if more:
        fa, fb = (F.array(*[F.col(f"{s}_{c}").cast("double") for c in more]) for s in ("_a", "_b"))
        cols.append(C.cosine(fa, fb).alias("feature_similarity"))
    return out.select(*pairs.columns, *cols)


def parent_similarity(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of each comment's vector with its parent's; 0 without a parent or with a zero vector."""
    rows = with_parent(df)
    v = vectors.select("id", F.col("embedding").alias("_v"))
    # under the same names on both sides, so that vectors are shuffled by id once; only replies take theirs to the parent
    own = rows.select("id", "pid").join(v, "id", "left").withColumn("_v", F.when(F.col("pid").isNotNull(), F.col("_v")))
    out = own.alias("own").join(v.alias("up"), F.col("own.pid") == F.col("up.id"), "left")
    return out.select("own.id", C.cosine_or_zero(F.col("own._v"), F.col("up._v")).alias("parent_similarity"))


def node_labels(nodes: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Label and masks per node: submissions 0, unlabelled comments -1."""
    out = nodes.join(labels.select(F.col("id").alias("node"), F.col("label").alias("_l")), "node", "left")
    out = out.join(splits.select(F.col("id").alias("node"), "split"), "node", "left")
    label = F.when(F.col("node_type") == "submission", 0).otherwise(F.coalesce("_l", F.lit(-1))).cast("int")
    masks = [F.coalesce(F.col("split") == s, F.lit(False)).alias(f"{s}_mask") for s in ("train", "val", "test")]
    return out.select("node", "node_type", label.alias("label"), *masks, F.col("_l").isNotNull().alias("labelled_mask"))


def sequence_edges(df: DataFrame) -> DataFrame:
    """Each comment to the next of its thread by (time, id): ranks are matched, no thread is held in one task."""
    ranked = rank_within(df.where("link_id is not null").select("link_id", "id", "created_utc"), ["link_id"], ["created_utc", "id"], "_r", time_chunk("created_utc"))
    nxt = ranked.select("link_id", (F.col("_r") - 1).alias("_r"), F.col("id").alias("dst"))
    return ranked.select("link_id", "_r", F.col("id").alias("src")).join(nxt, ["link_id", "_r"]).select("link_id", "src", "dst")
