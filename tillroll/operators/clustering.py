"""Customer segmentation: scaled feature vectors, k-means (best of several
starts), elbow curve, PCA projection and cluster profile (MLlib)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import logging

from tillroll import config

log = logging.getLogger(__name__)

FEATURES = ["TotalSales", "AverageOrderSize", "PurchaseFrequency"]
#: Rows of a task in a pass of k-means.
TASK_ROWS = 25_000


def scaled_vectors(features: DataFrame, cols=FEATURES, out: str = "scaled") -> DataFrame:
    """Assemble ``cols`` and z-scale them (mean 0, sample sd 1)."""
    v = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(features)
    sc = StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True).fit(v)
    return sc.transform(v).drop("_raw")


def _fit(vecs: DataFrame, k: int, seed: int, col: str):
    # random initial centres drawn from the rows, as in classic multi-start k-means
    km = KMeans(k=k, seed=seed, featuresCol=col, predictionCol="_cluster", maxIter=50,
                initMode="random")
    model = km.fit(vecs)
    return model.summary.trainingCost, seed, model


def kmeans_best_mllib(vecs: DataFrame, k: int = config.KMEANS_K,
                      starts: int = config.KMEANS_STARTS, seed: int = 111, col: str = "scaled"):
    """Best of ``starts`` separate MLlib fits (one iterative job set per start).
    Kept as a cross-check for :func:`multi_start_kmeans`."""
    results = [_fit(vecs, k, s, col) for s in range(seed, seed + starts)]
    return min(results, key=lambda r: (r[0], r[1]))


def _as_columns(vecs: DataFrame, col: str, d: int) -> DataFrame:
    arr = vector_to_array(col)
    return vecs.select(*[arr[i].alias(f"x{i}") for i in range(d)])


def _dealt(x: DataFrame, n_rows: int) -> DataFrame:
    """``x`` in partitions of about ``TASK_ROWS`` rows: every pass scans them against all
    runs' centres, so their number follows the rows and neither the files read (small
    ones are read as one) nor the session's shuffle partitions."""
    parts = max(1, -(-n_rows // TASK_ROWS))
    return x.repartition(parts) if parts > x.rdd.getNumPartitions() else x.coalesce(parts)


def _pass_partials(moving: list, settled: list, d: int, slots: int):
    """mapInPandas function of one pass: per Arrow batch, a map-side combine of two
    kinds of rows, both with (run, cluster) first.

    ``moving`` runs (their centres) get the count, squared-distance sum, coordinate
    sums and farthest row of each cluster (``goal`` = -1).  ``settled`` runs (centres
    and sizes) get, per cluster left, cluster joined (``goal``) and slot, the row whose
    change of cluster lowers the sum of squares most, with that gain in ``far``; a row's
    slot is a hash of its values, so one pass finds up to ``slots`` rows for a pair."""
    import numpy as np
    import pandas as pd

    def stacks(centers, first):
        by_k: dict[int, list[int]] = {}
        for i, c in enumerate(centers):
            by_k.setdefault(len(c), []).append(i)
        return [(k, own, first + np.array(own), np.array([centers[i] for i in own], dtype=float))
                for k, own in by_k.items()]

    lloyd = stacks(moving, 0)
    change = [(k, runs, cen, np.array([settled[i][1] for i in own], dtype=float))
              for k, own, runs, cen in stacks([c for c, _ in settled], len(moving)) if k > 1]
    xs = [f"x{i}" for i in range(d)]

    def distances(x, cen):                                                   # cen: (R, k, d)
        d2 = np.zeros((len(x), *cen.shape[:2]))                              # (n, R, k)
        for i in range(d):
            part = x[:, i, None, None] - cen[None, :, :, i]
            part *= part
            d2 += part
        lab = d2.argmin(axis=2)
        return d2, lab, np.take_along_axis(d2, lab[:, :, None], axis=2)[:, :, 0]

    def sums(x, out):
        for k, _, runs, cen in lloyd:
            _, lab, best = distances(x, cen)
            for j, run in enumerate(runs):
                cnt = np.bincount(lab[:, j], minlength=k)
                ss = np.bincount(lab[:, j], weights=best[:, j], minlength=k)
                tot = np.stack([np.bincount(lab[:, j], weights=x[:, i], minlength=k) for i in range(d)], axis=1)
                for c in np.nonzero(cnt)[0]:
                    own = np.flatnonzero(lab[:, j] == c)
                    far = own[best[own, j].argmax()]
                    out.append((int(run), int(c), -1, -1, int(cnt[c]), float(ss[c]), *tot[c].tolist(),
                                float(best[far, j]), *x[far].tolist()))

    def gains(x, out):
        slot = np.zeros(len(x), dtype=np.uint64)
        for i in range(d):
            slot = (slot ^ (x[:, i] + 0.0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        slot = ((slot >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)
        for k, runs, cen, size in change:
            d2, lab, best = distances(x, cen)
            for j, run in enumerate(runs):
                n_own = size[j][lab[:, j]]
                leave = np.where(n_own > 1, n_own / np.maximum(n_own - 1, 1) * best[:, j], -np.inf)
                gain = leave[:, None] - size[j] / (size[j] + 1) * d2[:, j, :]
                gain[np.arange(len(x)), lab[:, j]] = -np.inf
                goal = gain.argmax(axis=1)
                gain = gain[np.arange(len(x)), goal]
                rows = np.flatnonzero(gain > 0)
                order = rows[np.lexsort((*[-x[rows, i] for i in reversed(range(d))], -gain[rows]))]
                _, first = np.unique((lab[order, j] * k + goal[order]) * slots + slot[order], return_index=True)
                for r in order[first]:
                    out.append((int(run), int(lab[r, j]), int(goal[r]), int(slot[r]), 0, 0.0, *[0.0] * d,
                                float(gain[r]), *x[r].tolist()))

    names = ["run", "cluster", "goal", "slot", "n", "ss", *[f"s{i}" for i in range(d)],
             "far", *[f"f{i}" for i in range(d)]]

    def fn(batches):
        for pdf in batches:
            x = np.ascontiguousarray(pdf[xs].to_numpy(dtype=float))
            if len(x):
                out: list[tuple] = []
                sums(x, out)
                gains(x, out)
                yield pd.DataFrame(out, columns=names)
    return fn


def _change_clusters(run: dict, rows: list, least: float, most: int | None) -> bool:
    """Move the found rows one after another, best gain first, each only if it still
    lowers the sum of squares by ``least``; centres and sizes follow every move."""
    import numpy as np

    cen, size, done = run["centers"].copy(), run["sizes"].copy(), 0
    for row in sorted(rows, key=lambda r: tuple(r["far"]), reverse=True):
        if done == most:
            break
        a, b, x = row["cluster"], row["goal"], np.array(row["far"][1:])
        if size[a] < 2:
            continue
        gain = (size[a] / (size[a] - 1) * ((x - cen[a]) ** 2).sum()
                - size[b] / (size[b] + 1) * ((x - cen[b]) ** 2).sum())
        if gain <= least:
            continue
        cen[a] = (size[a] * cen[a] - x) / (size[a] - 1)
        cen[b] = (size[b] * cen[b] + x) / (size[b] + 1)
        size[a] -= 1
        size[b] += 1
        done += 1
    run["centers"], run["sizes"] = cen, size
    return done > 0


def _first_rows(vecs: DataFrame, key: str, k: int, col: str) -> list[list[float]]:
    """The rows of the k smallest keys (nulls last): a start that is the same everywhere."""
    rows = vecs.select(key, vector_to_array(col).alias("_a")).orderBy(F.col(key).asc_nulls_last()).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"k = {k} clusters need as many rows; there are {len(rows)}")
    return [list(r["_a"]) for r in rows]


def _starting_rows(x: DataFrame, xs: list[str], runs: int, k: int, seed: int) -> list[list[list[float]]]:
    """``runs`` sets of k distinct rows, drawn from all distinct rows of ``x`` by a
    seeded hash: the first runs * k in that order, or, of fewer rows, k of them
    anew for each run.  Fails if there are fewer than k distinct rows."""
    import numpy as np

    drawn = (x.distinct().orderBy(F.xxhash64(*xs, F.lit(seed), F.lit(k)), *xs)
             .limit(runs * k).collect())                       # bounded by the parameters
    if len(drawn) < k:
        raise ValueError(f"k = {k} clusters need as many distinct rows; there are {len(drawn)}")
    rows = [[float(r[c]) for c in xs] for r in drawn]
    if len(rows) == runs * k:
        return [rows[i * k:(i + 1) * k] for i in range(runs)]
    rng = np.random.default_rng(seed * 1009 + k)
    return [[rows[i] for i in rng.choice(len(rows), size=k, replace=False)] for _ in range(runs)]


def multi_start_kmeans(vecs: DataFrame, ks, starts: int, seed: int = 111, col: str = "scaled",
                       max_iter: int = 500, tol: float = 1e-7, exchange: bool = True,
                       slots: int = 64, moves: int | None = None, start_key: str | None = None):
    """K-means for every (k, start) pair at once, by Lloyd passes
    followed by changes of single rows (Hartigan and Wong's optimality).

    All runs share each pass over the data: every task computes, for its
    rows and every run, the nearest current centre (NumPy, per Arrow batch)
    and emits only per-(run, cluster) partial sums; a groupBy adds them up into
    the new centres and the within-cluster sum of squares.  A run whose centres
    stand still has, in the next pass, its best changes of a row from one cluster
    to another combined per (run, from, to, slot).  They are made one by one, each
    checked against the centres that the ones before left (at most ``moves`` a
    pass); after them the run goes back to Lloyd passes.  A run ends when no change
    gains more than 1e-9 of its sum of squares, so it never ends above plain
    Lloyd from the same start.  Runs that stand still at the same centres go on
    as one.

    The centres travel with the task closure (runs * k * d doubles), and a pass
    returns at most runs * k * (k - 1) * slots rows -- fixed by the parameters, not
    by the data.  Starts are distinct rows drawn from the whole table; with
    ``start_key`` there is one, the rows of the k smallest keys.  A cluster that lost all its rows moves to the row
    farthest from its centre.  Runs that still move after ``max_iter`` passes are an error.

    Returns a pandas frame (run, k, start_seed, wss) and the final centres
    {run: array[k][d]} -- both sized by the parameters.
    """
    import numpy as np
    import pandas as pd

    d = len(vecs.select(col).first()[0])
    x = _as_columns(vecs, col, d)
    x = _dealt(x, vecs.count()).persist()
    try:
        xs = [f"x{i}" for i in range(d)]
        runs = []
        for k in ks:
            given = ([_first_rows(vecs, start_key, k, col)] if start_key
                     else _starting_rows(x, xs, starts, k, seed))
            for s, rows in enumerate(given):
                runs.append({"k": k, "seed": seed + s, "centers": np.array(rows, dtype=float), "wss": float("nan")})
        schema = "run int, cluster int, goal int, slot int, n long, ss double, " + ", ".join(
            f"s{i} double" for i in range(d)) + ", far double, " + ", ".join(f"f{i} double" for i in range(d))
        moving, settled, same = list(runs), [], {}
        for it in range(max_iter):
            fn = _pass_partials([r["centers"].tolist() for r in moving],
                                [(r["centers"].tolist(), r["sizes"].tolist()) for r in settled], d, slots)
            agg = (x.mapInPandas(fn, schema).groupBy("run", "cluster", "goal", "slot")
                   .agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"),
                        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)],
                        F.max(F.struct("far", *[f"f{i}" for i in range(d)])).alias("far"))
                   .collect())
            by_run: dict[int, list] = {}
            for row in agg:
                by_run.setdefault(row["run"], []).append(row)
            still = [r for i, r in enumerate(settled)
                     if _change_clusters(r, by_run.get(len(moving) + i, []), 1e-9 * r["wss"], moves)]
            settled = []
            for i, r in enumerate(moving):
                rows = by_run.get(i, [])
                r["wss"] = sum(row["ss"] for row in rows)
                new = r["centers"].copy()
                for row in rows:
                    new[row["cluster"]] = np.array([row[f"s{j}"] for j in range(d)]) / row["n"]
                empty = sorted(set(range(r["k"])) - {row["cluster"] for row in rows})
                spare = sorted((tuple(row["far"]) for row in rows), reverse=True)
                for c, far in zip(empty, spare):
                    if far[0] > 0:
                        new[c] = far[1:]
                stands = float(np.abs(new - r["centers"]).max()) <= tol
                r["centers"] = new
                if not stands:
                    still.append(r)
                elif exchange and r["k"] > 1:
                    r["sizes"] = np.zeros(r["k"])
                    for row in rows:
                        r["sizes"][row["cluster"]] = row["n"]
                    r["like"] = same.setdefault((r["k"], *sorted(map(tuple, np.round(new, 6) + 0.0))), r)
                    if r["like"] is r:
                        settled.append(r)
            moving = still
            if not moving and not settled:
                log.info("multi_start_kmeans: %d runs, %d passes", len(runs), it + 1)
                break
        else:
            raise RuntimeError(f"{len(moving) + len(settled)} k-means runs still move after {max_iter} passes")
        for r in runs:
            end = r
            while end.get("like", end) is not end:
                end = end["like"]
            r["wss"], r["centers"] = end["wss"], end["centers"]
        table = pd.DataFrame({"run": range(len(runs)), "k": [r["k"] for r in runs],
                              "start_seed": [r["seed"] for r in runs], "wss": [r["wss"] for r in runs]})
        return table, {i: r["centers"] for i, r in enumerate(runs)}
    finally:
        x.unpersist()


def kmeans_best(vecs: DataFrame, k: int = config.KMEANS_K, starts: int = config.KMEANS_STARTS,
                seed: int = 111, col: str = "scaled", **how):
    """Best of ``starts`` runs for one k: (wss, centres array[k][d]); ``how`` goes
    to :func:`multi_start_kmeans`."""
    table, centers = multi_start_kmeans(vecs, [k], starts, seed, col, **how)
    best = table.sort_values(["wss", "start_seed"]).iloc[0]
    return float(best["wss"]), centers[int(best["run"])]


def total_ss(vecs: DataFrame, col: str = "scaled") -> float:
    """Sum of squared distances to the overall mean (the k = 1 WSS)."""
    arr = vecs.select(vector_to_array(col).alias("_a"))
    n = len(vecs.select(col).first()[0])
    aggs = []
    for i in range(n):
        x = F.col("_a")[i]
        aggs.append(F.coalesce(F.var_samp(x) * (F.count(x) - 1), F.lit(0.0)))
    row = arr.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggs)]).first()
    return float(sum(row))


def elbow(vecs: DataFrame, ks=config.ELBOW_K, starts: int = config.ELBOW_STARTS,
          seed: int = 111, col: str = "scaled", **how) -> DataFrame:
    """Best-of-``starts`` WSS for each k, all runs batched together."""
    table, _ = multi_start_kmeans(vecs, list(ks), starts, seed, col, **how)
    best = table.groupby("k")["wss"].min()
    rows = [(int(k), float(w)) for k, w in best.items()]
    return vecs.sparkSession.createDataFrame(rows, "k int, wss double")


def assign(vecs: DataFrame, centers, col: str = "scaled", out: str = "Cluster") -> DataFrame:
    """1-based label of the nearest centre (centres broadcast, k * d)."""
    cen = vecs.sparkSession.createDataFrame([([[float(v) for v in c] for c in centers],)],
                                            "centers array<array<double>>")
    arr = vector_to_array(col)
    d = len(centers[0])
    x = F.array(*[arr[i] for i in range(d)])
    dists = F.transform("centers", lambda c, i: F.struct(
        F.aggregate(F.zip_with(c, x, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                    lambda acc, v: acc + v).alias("d2"), i.alias("cluster")))
    return (vecs.crossJoin(F.broadcast(cen))
            .withColumn(out, (F.array_min(dists).getField("cluster") + 1).cast("int"))
            .drop("centers"))


def _signed_scores(pca, k: int, tolerance: float = 1e-12) -> list:
    """Columns of the scores with a fixed sign (the loading of greatest magnitude,
    the first of equal ones, is positive); a component whose share of variance
    is below the tolerance is noise and scores 0."""
    loadings, share = pca.pc.toArray(), pca.explainedVariance.toArray()
    out = []
    for i in range(k):
        size = abs(loadings[:, i])
        first = int((size >= size.max() * (1 - 1e-9)).argmax())
        sign = 1.0 if loadings[first, i] > 0 else -1.0
        out.append(F.col("_pca")[i] * F.lit(sign) if share[i] > tolerance else F.lit(0.0))
    return out


def segment(features: DataFrame, k: int = config.KMEANS_K, starts: int = config.KMEANS_STARTS,
            seed: int = 111, pca_k: int = config.PCA_K, **how):
    """Cluster the scaled features (best of ``starts``), attach
    1-based labels and the PCA scores of the scaled matrix.
    Returns (labelled frame, WSS)."""
    vecs = scaled_vectors(features).persist()
    try:
        cost, centers = kmeans_best(vecs, k, starts, seed, **how)
        lab = assign(vecs, centers)
        # PCA of the scaled matrix: the vectors are already centred; Spark's
        # PCA does not centre by itself.
        pca = PCA(k=pca_k, inputCol="scaled", outputCol="_pc").fit(vecs)
        out = pca.transform(lab).withColumn("_pca", vector_to_array("_pc"))
        out = out.select(*features.columns, "Cluster",
                         *[score.alias(f"PC{i + 1}") for i, score in enumerate(_signed_scores(pca, pca_k))])
        # small result (one row per customer): written to the shared
        # checkpoint folder so it outlives the cached vectors
        out = out.checkpoint()
    finally:
        vecs.unpersist()
    return out, cost


def cluster_profile(labelled: DataFrame) -> DataFrame:
    """Mean sales, order size and purchase frequency per cluster."""
    return labelled.groupBy("Cluster").agg(
        F.avg("TotalSales").alias("AverageSales"),
        F.avg("AverageOrderSize").alias("AvgOrderSize"),
        F.avg("PurchaseFrequency").alias("AvgPurchaseFrequency"),
        F.count(F.lit(1)).alias("customers"))
