"""Cluster representatives, cohesion, refinement and quality measures.

For unit vectors the sum of a member's similarities to its cluster is its product with the cluster's sum
vector, so representatives and mean similarities cost one vector a cluster instead of all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from explainkit.functions.hashing import hash52
from explainkit.functions.vectors import distance, dot, l2_normalize
from explainkit.plans.storage import persist_table


def sum_vectors(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``(cluster, m, s)``: size and sum vector, added up place by place with partial sums."""
    each = members.select(cluster, F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    sums = each.groupBy(cluster, "d").agg(F.sum("x").alias("x"), F.count("*").alias("m"))
    packed = sums.groupBy(cluster).agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("d", "x"))).alias("l"))
    return packed.select(cluster, "m", F.transform("l", lambda e: e["x"]).alias("s"))


def representatives(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``(cluster, rep, cluster_size, rep_mean_sim, cluster_mean_sim)``; a singleton is its own, with ones; ties go to the smaller id."""
    joined = members.join(sum_vectors(members, cluster), cluster)
    mean = F.when(F.col("m") > 1, (dot(F.col("embedding"), F.col("s")) - 1) / (F.col("m") - 1)).otherwise(1.0)
    own = F.when(F.col("m") > 1, (dot(F.col("s"), F.col("s")) - F.col("m")) / (F.col("m") * (F.col("m") - 1))).otherwise(1.0)
    scored = joined.select(cluster, "id", "m", F.round(mean, 9).alias("mean"), own.alias("own"))
    best = scored.groupBy(cluster).agg(F.max(F.struct(F.col("mean"), (-F.col("id")).alias("neg"))).alias("b"), F.max("m").alias("cluster_size"), F.max("own").alias("cluster_mean_sim"))
    return best.select(cluster, (-F.col("b.neg")).alias("rep"), "cluster_size", F.col("b.mean").alias("rep_mean_sim"), "cluster_mean_sim")


def mean_similarity(members: DataFrame, cluster: str = "cluster_id", diagonal: bool = False) -> DataFrame:
    """Mean pairwise cosine of each cluster, with or without each member's similarity to itself."""
    s = sum_vectors(members, cluster)
    whole = dot(F.col("s"), F.col("s"))
    value = whole / (F.col("m") * F.col("m")) if diagonal else F.when(F.col("m") > 1, (whole - F.col("m")) / (F.col("m") * (F.col("m") - 1))).otherwise(1.0)
    return s.select(cluster, "m", value.alias("mean_sim"))


def lowest_similarity(members: DataFrame, cluster: str = "cluster_id", block: int = 1024) -> DataFrame:
    """``(cluster, low)``: the least similarity of two members; no row for singletons.

    A cluster is dealt to blocks; a pair of blocks is a task and answers one number, so a cluster of any size is spread.
    """
    sizes = members.groupBy(cluster).agg(F.count("*").alias("_m")).where("_m > 1").select(cluster, F.ceil(F.col("_m") / block).alias("_parts"))
    dealt = members.join(sizes, cluster).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_other")
    rows = dealt.select(F.col(cluster).alias("c"), F.col("embedding").cast("array<double>").alias("v"), "_own", other).select("c", "v", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"))

    def least(key, pdf):
        import numpy as np
        import pandas as pd

        v, low = np.stack(pdf["v"].to_numpy()), np.inf
        for at in range(0, len(v), 512):
            sims = v[at : at + 512] @ v.T
            sims[np.arange(len(sims)), at + np.arange(len(sims))] = np.inf
            low = min(low, float(sims.min()))
        return pd.DataFrame({"c": [key[0]], "low": [low]})

    kind = dict(members.dtypes)[cluster]
    return rows.groupBy("c", "a", "b").applyInPandas(least, f"c {kind}, low double").groupBy(F.col("c").alias(cluster)).agg(F.round(F.min("low"), 12).alias("low")).where("low < double('infinity')")


def cohesion(members: DataFrame, tau: float, cluster: str = "cluster_id") -> DataFrame:
    """``(cluster, cohesive)``: whether all pairs reach ``tau``; singletons do."""
    return members.select(cluster).distinct().join(lowest_similarity(members, cluster), cluster, "left").select(cluster, F.coalesce(F.col("low") >= tau, F.lit(True)).alias("cohesive"))


def second_moments(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``(cluster, m, own, s2, f2)``: size, the sum of (1 - |x|^2)^2, the squared length of the sum vector and the
    squared Frobenius norm of the second-moment matrix. Matrices are added up in each batch before they meet."""
    kind = dict(members.dtypes)[cluster]

    def partial(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for name, part in pdf.groupby("c", sort=False):
                x = np.stack(part["v"].to_numpy())
                own = float(((1 - (x * x).sum(axis=1)) ** 2).sum())
                out.append((name, len(x), own, x.sum(axis=0), (x.T @ x).ravel()))
            if out:
                yield pd.DataFrame(out, columns=["c", "m", "own", "s", "f"])

    rows = members.select(F.col(cluster).alias("c"), F.col("embedding").cast("array<double>").alias("v"))
    parts = rows.mapInPandas(partial, f"c {kind}, m long, own double, s array<double>, f array<double>")
    sizes = parts.groupBy("c").agg(F.sum("m").alias("m"), F.sum("own").alias("own"))
    squared = lambda column, name: parts.select("c", F.posexplode(column).alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("x")).groupBy("c").agg(F.sum(F.col("x") * F.col("x")).alias(name))
    return sizes.join(squared("s", "s2"), "c").join(squared("f", "f2"), "c").select(F.col("c").alias(cluster), "m", "own", "s2", "f2")


def sse(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``(total, mean)`` of unit vectors: within-cluster squared distances over twice the size; singletons count as clusters
    with zero. All pairs' (1 - x y)^2 follow from the size, the sum vector and the second moments, without any pair."""
    pairs = F.col("m") * F.col("m") - 2 * F.col("s2") + F.col("f2") - F.col("own")
    each = second_moments(members, cluster).select((F.greatest(pairs, F.lit(0.0)) / (2 * F.col("m"))).alias("e"))
    return each.agg(F.sum("e").alias("total"), F.avg("e").alias("mean"))


def ssb(reps: DataFrame, points: int, weighted: bool = True) -> DataFrame:
    """Between-cluster squared distances of unit ``reps (cluster_id, m, embedding)``; each column weighs its share of the
    points. One pass with the representatives' sum vector and second moments (as many numbers as dimensions squared)."""
    import numpy as np
    import pandas as pd

    rows = reps.select("m", F.col("embedding").cast("array<double>").alias("v"))

    def partial(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                yield pd.DataFrame({"k": [len(x)], "s": [x.sum(axis=0)], "f": [(x.T @ x).ravel()]})

    held = rows.mapInPandas(partial, "k long, s array<double>, f array<double>")
    total = lambda c: np.array([r["x"] for r in held.select(F.posexplode(c).alias("d", "x")).groupBy("d").agg(F.sum("x").alias("x")).orderBy("d").collect()])
    s, f, k = total("s"), total("f"), held.agg(F.sum("k")).first()[0] or 0
    if not k:
        return reps.sparkSession.createDataFrame([(None,)], "ssb double")

    def column(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                yield pd.DataFrame({"dd": k - 2 * (x @ s) + ((x @ f.reshape(len(s), len(s))) * x).sum(axis=1), "m": pdf["m"]})

    weight = F.col("m") / F.lit(float(points)) if weighted else F.lit(1.0)
    return rows.mapInPandas(column, "dd double, m long").agg((F.sum(F.col("dd") * weight) / (2.0 * k)).alias("ssb"))


def diameters(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``(cluster, diameter)``: largest distance inside; singletons zero."""
    far = lowest_similarity(members, cluster)
    return members.select(cluster).distinct().join(far, cluster, "left").select(cluster, F.coalesce(distance(F.col("low")), F.lit(0.0)).alias("diameter"))


def intercluster_min(members: DataFrame, cluster: str = "cluster_id", block: int = 2048) -> DataFrame:
    """One row ``min_distance`` between members of different clusters; pairs of blocks are tasks, each answers one number."""
    parts = max(1, -(-members.count() // block))
    dealt = members.select(F.col(cluster).alias("c"), F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("own"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("other")
    rows = dealt.select("c", "v", "own", other).select("c", "v", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def least(pdf):
        import numpy as np
        import pandas as pd

        v, c = np.stack(pdf["v"].to_numpy()), pdf["c"].to_numpy()
        best = np.inf
        for at in range(0, len(v), 512):
            d = np.maximum(0, 1 - v[at : at + 512] @ v.T)
            d[c[at : at + 512, None] == c[None, :]] = np.inf
            best = min(best, float(d.min()))
        return pd.DataFrame({"d": [best]})

    return rows.groupBy("a", "b").applyInPandas(least, "d double").agg(F.min("d").alias("min_distance"))


def dunn_index(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Least distance between clusters over the largest diameter; infinite where all diameters are zero, NaN without two clusters."""
    wide = diameters(members, cluster).agg(F.max("diameter").alias("d"))
    both = intercluster_min(members, cluster).crossJoin(wide)
    low, d = F.col("min_distance"), F.col("d")
    return both.select(F.when(low.isNull() | (low == float("inf")), F.lit(float("nan"))).when(d == 0, F.lit(float("inf"))).otherwise(low / d).alias("dunn"))


def refine_components(members: DataFrame, edges: DataFrame, component: str = "component", intra: float = 0.85, merge: float = 0.90) -> DataFrame:
    """``(component, cluster_id, id)``: components split by pivot expansion; a cluster is named by its smallest id.

    A component whose pairs all reach ``intra`` stays whole; pairs of blocks tell, so no task multiplies a whole
    component. In the others the node with most neighbours left takes them; its group joins the open cluster if it is
    ``merge``-similar to all that cluster's pivots, else the open cluster is closed. That is greedy by definition, so
    one task a component; it holds the component's vectors and edges, and ties go to the smaller id.
    """
    kind = dict(members.dtypes)[component]
    rows = members.select(component, "id", l2_normalize(F.col("embedding")).alias("embedding"))
    split = persist_table(lowest_similarity(rows, component).where(F.col("low") < intra).select(component), "split")
    least = rows.groupBy(component).agg(F.min("id").alias("cluster_id"))
    whole = rows.join(split, component, "left_anti").join(least, component).select(component, "cluster_id", "id")
    loose = rows.join(split, component, "left_semi")
    near = edges.join(loose.select(F.col("id").alias("src"), component), "src").groupBy(component).agg(F.collect_list(F.struct("src", "dst")).alias("_edges"))
    marked = loose.groupBy(component).agg(F.collect_list(F.struct("id", F.col("embedding").alias("v"))).alias("_nodes")).join(near, component, "left")

    def refine(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, nodes, links in zip(pdf[component], pdf["_nodes"], pdf["_edges"], strict=True):
                vectors = {int(n["id"]): n["v"] for n in nodes}
                pairs = [] if links is None else [(int(e["src"]), int(e["dst"])) for e in links]
                for group in refine_one(vectors, pairs, merge):
                    out += [(name, group[0], i) for i in group]
            yield pd.DataFrame(out, columns=[component, "cluster_id", "id"])

    return whole.unionByName(marked.mapInPandas(refine, f"{component} {kind}, cluster_id long, id long"))


def refine_one(vectors: dict, pairs: list[tuple[int, int]], merge: float) -> list[list[int]]:
    """Pivot expansion of one component of unit vectors; sorted groups. Nodes are picked from a heap of neighbours left."""
    import heapq

    import numpy as np

    ids = sorted(vectors)
    place = {n: i for i, n in enumerate(ids)}
    x = np.stack([np.asarray(vectors[n], dtype=float) for n in ids])
    near: list[set[int]] = [set() for _ in ids]
    for a, b in pairs:
        if a in place and b in place and a != b:
            near[place[a]].add(place[b])
            near[place[b]].add(place[a])
    left, groups, open_group, pivots = set(range(len(ids))), [], set(), []
    heap = [(-len(near[n]), n) for n in left]
    heapq.heapify(heap)
    while left:
        degree, pivot = heapq.heappop(heap)
        if pivot not in left:
            continue
        now = len(near[pivot] & left)
        if now != -degree:  # some neighbours are gone since
            heapq.heappush(heap, (-now, pivot))
            continue
        taken = {pivot} | near[pivot] & left
        if open_group and float((x[pivots] @ x[pivot]).min()) < merge:
            groups.append(open_group)
            open_group, pivots = set(), []
        open_group |= taken
        pivots.append(pivot)
        left -= taken
    groups.append(open_group)
    return [sorted(ids[i] for i in g) for g in groups]


def sample_clusters(clusters: DataFrame, n: int, min_size: int, seed: int = 0) -> DataFrame:
    """``n`` clusters without replacement, by size: exponential keys from a seeded hash, the smallest win."""
    u = (hash52("cluster_id", seed) + 1) / F.lit(2.0**52 + 2)
    return clusters.where(F.col("cluster_size") >= min_size).orderBy(-F.log(u) / F.col("cluster_size"), "cluster_id").limit(n)


def stratified_sample(df: DataFrame, stratum: str, order: str, total: int) -> DataFrame:
    """About ``total`` rows, each stratum by its share (at least one row), first by hash of ``order``."""
    n = df.count()
    size = df.groupBy(stratum).agg(F.greatest(F.lit(1), F.round(F.lit(float(total)) * F.count("*") / F.lit(float(max(n, 1)))).cast("long")).alias("_want"))
    at = F.row_number().over(W.partitionBy(stratum).orderBy(hash52(order), order))
    return df.withColumn("_at", at).join(size, stratum).where("_at <= _want").drop("_at", "_want")
