"""Reproducible sampling, splitting and class balancing.

Randomness is always a hash of row content and a seed (``xxhash64``), never
``rand()``: the same seed gives the same rows under any partitioning, and a
lost executor recomputes exactly the rows it lost. Exact per-class ranks (for
exact split sizes and undersampling counts) are computed without gathering a
class in one task: rows are bucketed by the top bits of their hash, bucket
counts give each bucket's starting rank, and only rows inside one bucket are
ordered together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HASH_BITS = 62
_BUCKET_BITS = 16


def row_hash(cols: Sequence[str | Column], seed: int, salt: str = "") -> Column:
    """Non-negative 62-bit hash of the given columns, seed and salt."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.pmod(F.xxhash64(F.lit(int(seed)), F.lit(salt), *parts), F.lit(1 << _HASH_BITS))


def hash_uniform(cols: Sequence[str | Column], seed: int, salt: str = "") -> Column:
    """A reproducible uniform draw in [0, 1) per row."""
    return (F.shiftright(row_hash(cols, seed, salt), _HASH_BITS - 53).cast("double")) / float(1 << 53)


def hash_rank(df: DataFrame, part: Sequence[str], key: Sequence[str], seed: int, out: str = "_rank") -> DataFrame:
    """0-based rank of each row within ``part`` in hash order (ties broken by ``key``).

    Exact and distributed: 2^16 hash buckets per part; the bucket histogram
    (parts x 65536 rows at most) gives each bucket's offset, and ordering is
    only needed inside a bucket (about n / 65536 rows).
    """
    h = row_hash(list(key), seed, "rank")
    x = df.withColumn("_h", h).withColumn("_bk", F.shiftright(F.col("_h"), _HASH_BITS - _BUCKET_BITS))
    x = x.persist(StorageLevel.MEMORY_AND_DISK)  # read twice (histogram, ranks): compute the input once
    hist = x.groupBy(*part, "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    cw = Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_off", F.coalesce(F.sum("_cnt").over(cw), F.lit(0))).drop("_cnt")
    on = [x[c].eqNullSafe(hist[c]) for c in part] + [x["_bk"] == hist["_bk"]]  # a null label is a class of its own
    x = x.join(hist, on, "inner").drop(*[hist[c] for c in [*part, "_bk"]])
    inner = Window.partitionBy(*part, "_bk").orderBy("_h", *key)
    return x.withColumn(out, F.col("_off") + F.row_number().over(inner) - 1).drop("_h", "_bk", "_off")


# -- B1 / B2 -------------------------------------------------------------------------
def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct keys chosen by hash order (distributed top-n, reproducible)."""
    keys = df.select(key).distinct()
    return keys.orderBy(row_hash([key], seed, "keys"), F.col(key)).limit(n)


def sample_rows(df: DataFrame, n: int | None, seed: int = 42, cols: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows in hash order; ``None`` keeps every row."""
    if n is None:
        return df
    cols = list(cols or df.columns)
    return df.orderBy(row_hash(cols, seed, "rows"), *cols).limit(n)


def _with_class(df: DataFrame, per_class: DataFrame, label: str) -> DataFrame:
    """Adds the columns of a one-row-per-class table; rows without a label are a class of their own and stay.

    The table is left to Spark's own size check, since nothing bounds the number of classes.
    """
    c = per_class.withColumnRenamed(label, "_class")
    return df.join(c, df[label].eqNullSafe(c["_class"]), "inner").drop("_class")


# -- B5 ----------------------------------------------------------------------------------
def stratified_split(df: DataFrame, label: str, fractions: Sequence[float], seed: int = 42,
                     key: Sequence[str] | None = None, names: Sequence[str] | None = None,
                     out: str = "split") -> DataFrame:
    """Assign each row a split so every class is cut in exact proportions.

    Per class of size n, split i receives ranks ``[round(n*c_{i-1}), round(n*c_i))``
    where ``c`` is the cumulative fraction; the last split takes the rest.
    """
    key = list(key or df.columns)
    names = list(names or ["train", "validation", "test"][: len(fractions)])
    ranked = hash_rank(df, [label], key, seed)
    # class sizes come from a grouped count, not from a window over the whole class
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _with_class(ranked, sizes, label)
    cum, expr = 0.0, None
    for i, f in enumerate(fractions[:-1]):
        cum += f
        bound = F.round(F.col("_n") * F.lit(cum))
        cond = F.col("_rank") < bound
        expr = F.when(cond, F.lit(names[i])) if expr is None else expr.when(cond, F.lit(names[i]))
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))
    return ranked.withColumn(out, expr).drop("_rank", "_n")


# -- B6 / B8 / B12 ----------------------------------------------------------------------
def class_counts(df: DataFrame, label: str = "target") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def undersample(df: DataFrame, label: str = "target", ratio: float = 0.1, seed: int = 42,
                key: Sequence[str] | None = None) -> DataFrame:
    """Keep every minority row and ``min(n_major, floor(n_minor / ratio))`` majority rows.

    ``ratio`` is the minority/majority ratio after sampling (0.1 = 1:10).
    Majority rows are chosen by hash rank, so the count is exact.
    """
    key = list(key or df.columns)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)  # counted, ranked and filtered: compute once
    counts = class_counts(df, label)
    n_min = counts.agg(F.min("n")).first()[0]
    keep = F.least(F.col("_n"), F.floor(F.lit(float(n_min)) / F.lit(float(ratio))))
    ranked = _with_class(hash_rank(df, [label], key, seed), counts.withColumnRenamed("n", "_n"), label)
    is_minor = F.col("_n") == F.lit(n_min)
    return ranked.filter(is_minor | (F.col("_rank") < keep)).drop("_rank", "_n")


def needs_balancing(df: DataFrame, label: str = "target", min_minority: int = 6, max_ratio: float = 0.4) -> bool:
    """B8 guard: skip resampling with < ``min_minority`` minority rows or ratio >= ``max_ratio``."""
    r = class_counts(df, label).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"),
                                    F.max("n").alias("hi")).first()
    if r["k"] < 2 or r["lo"] < min_minority:
        return False
    return (r["lo"] / r["hi"]) < max_ratio


def class_weights(df: DataFrame, label: str = "target", out: str = "weight") -> DataFrame:
    """Balanced weights ``n / (n_classes * n_c)`` as a column (MLlib ``weightCol``)."""
    counts = class_counts(df, label)
    total = counts.agg(F.sum("n")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    w = counts.select(label, (total / (k * F.col("n"))).cast("double").alias(out))
    return _with_class(df, w, label)


# -- B2 / B3 / B4: early-warning candidate rows --------------------------------------------
_US_PER_HOUR = 3_600_000_000


def positives(outages: DataFrame, windows: Sequence[int], seed: int = 42, limit: int | None = None,
              key: str = "county_fips", ts: str = "event_time") -> DataFrame:
    """Every (sampled) outage x window: ``prediction_time = event - U(0.25, max(w, 0.5))`` hours.

    The jitter is a hash draw per (event, window), so it is the same under any
    partitioning. ``limit`` reproduces the reference's cap on events
    (hash order); ``None`` uses all outages.
    """
    ev_cols = [key, ts, "max_customers", "duration_hours"]
    events = sample_rows(outages.select(*ev_cols), limit, seed, ev_cols)
    x = events.withColumn("window_hours", F.explode(F.array(*[F.lit(int(w)) for w in windows])))
    u = hash_uniform([*ev_cols, "window_hours"], seed, "jitter")
    hi = F.greatest(F.col("window_hours").cast("double"), F.lit(0.5))
    offset_h = F.lit(0.25) + u * (hi - F.lit(0.25))
    t = F.timestamp_micros(F.unix_micros(F.col(ts)) - (offset_h * _US_PER_HOUR).cast("long"))
    return x.select(F.col(key), t.alias("prediction_time"), "window_hours", F.lit(1).alias("target"))


def indexed_keys(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Distinct keys with a dense 0-based index (in hash order, via ``hash_rank``)."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return hash_rank(keys, [], [key], seed, out="idx")


def free_hours(outages: DataFrame, windows: Sequence[int], key: str = "county_fips", ts: str = "event_time",
               max_window_hours: int | None = None) -> DataFrame:
    """key, window_hours, first, hours, lo_us: the maximal runs of whole hours t (counted from the first outage at ``lo_us``) with no outage of the
    key in ``[t, t + window)``, up to the last outage less the longest window.

    An outage in hour k takes the hours k - window + 1 .. k, so a key's runs lie between neighbours among its distinct hours: the
    rows of a key that meet are as many as hours, however many outages there are.
    """
    max_w = int(max_window_hours or max(windows))
    st = outages.agg(F.unix_micros(F.min(ts)).alias("lo"), F.unix_micros(F.max(ts)).alias("hi")).first()
    lo_us = int(st["lo"] or 0)
    total = max(1, (int(st["hi"] or 0) - max_w * _US_PER_HOUR - lo_us) // _US_PER_HOUR)
    hour = F.floor((F.unix_micros(ts) - F.lit(lo_us)) / F.lit(_US_PER_HOUR)).cast("long")
    taken = outages.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias(key), hour.alias("hour")).distinct()
    by_hour = Window.partitionBy(key).orderBy("hour")
    taken = taken.select(key, "hour", F.coalesce(F.lag("hour").over(by_hour), F.lit(-1)).alias("after"), F.lead("hour").over(by_hour).isNull().alias("last"))
    # before each taken hour, and behind the last one
    gap = F.struct(F.col("after").alias("after"), F.col("hour").alias("until"), F.lit(True).alias("shrinks"))
    tail = F.struct(F.col("hour").alias("after"), F.lit(total).cast("long").alias("until"), F.lit(False).alias("shrinks"))
    gaps = taken.select(key, F.explode(F.when(F.col("last"), F.array(gap, tail)).otherwise(F.array(gap))).alias("g"))
    gaps = gaps.select(key, "g.*", F.explode(F.array(*[F.lit(int(w)) for w in dict.fromkeys(windows)])).alias("window_hours"))
    first = F.col("after") + 1
    end = F.least(F.when(F.col("shrinks"), F.col("until") - F.col("window_hours") + 1).otherwise(F.col("until")), F.lit(total).cast("long"))
    return gaps.select(key, "window_hours", first.alias("first"), (end - first).alias("hours"), F.lit(lo_us).cast("long").alias("lo_us")).filter("hours > 0")


def negatives(outages: DataFrame, n: int, windows: Sequence[int], seed: int = 42,
              key: str = "county_fips", ts: str = "event_time", max_window_hours: int | None = None) -> DataFrame:
    """``n`` negative rows: hash-picked county, whole hour and window with no outage in ``[t, t+w)``.

    Every (county, hour, window) that is free is equally likely, as if others had been drawn and rejected, but each draw is mapped
    straight into the free hours: their runs are laid end to end (prefix sums), and a draw is a place on that line. One
    round fills every slot however dense the outages are; without any free hour it is an error.
    """
    spark = outages.sparkSession
    gaps = free_hours(outages, windows, key, ts, max_window_hours)
    # a run's place on the line: totals of 2^16 hash buckets of keys, then inside a bucket
    gaps = gaps.withColumn("_bk", F.shiftright(row_hash([key], seed, "line"), _HASH_BITS - _BUCKET_BITS)).persist(StorageLevel.MEMORY_AND_DISK)
    free = int(gaps.agg(F.sum("hours")).first()[0] or 0)
    if n and not free:
        raise ValueError(f"no free hour for {n} negatives: outages cover all hours")
    before = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    buckets = gaps.groupBy("_bk").agg(F.sum("hours").alias("_sum")).select("_bk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bk").orderBy(key, "window_hours", "first").rowsBetween(Window.unboundedPreceding, -1)
    line = gaps.join(buckets, "_bk").withColumn("_at", F.col("_off") + F.coalesce(F.sum("hours").over(inside), F.lit(0)))

    # draws meet runs in equal cells of the line
    cells = max(1, min(int(n), 1 << _BUCKET_BITS))
    width = -(-max(free, 1) // cells)
    cell = F.explode(F.sequence(F.expr(f"_at div {width}"), F.expr(f"(_at + hours - 1) div {width}")))
    line = line.select(key, "window_hours", "first", "hours", "lo_us", "_at", cell.alias("_cell"))
    draws = spark.range(0, int(n)).select(F.pmod(row_hash(["id"], seed, "free"), F.lit(max(free, 1))).alias("_u")).withColumn("_cell", F.expr(f"_u div {width}"))
    hit = draws.join(line, "_cell").filter("_u >= _at AND _u < _at + hours")
    hour = F.col("first") + F.col("_u") - F.col("_at")
    return hit.select(F.col(key).alias(key), F.timestamp_micros(F.col("lo_us") + hour * F.lit(_US_PER_HOUR)).alias("prediction_time"), "window_hours",
                      F.lit(0).alias("target"))


# -- B7 / B9 / B10 / B11: synthetic minority rows over exact neighbours -----------------------
def _indexed(df: DataFrame, seed: int) -> DataFrame:
    return hash_rank(df, [], ["id"], seed, out="idx")


def _interpolate(spark, bases: DataFrame, nbrs: DataFrame, feats: DataFrame, n_synth, seed: int,
                 k: int, label_value: int, salt: str) -> DataFrame:
    """Synthetic row j: base = bases[hash(j) mod n], neighbour = one of its k, x + u (nn - x)."""
    nb = bases.count()
    if n_synth <= 0 or nb == 0:
        return spark.createDataFrame([], "features array<double>, target int")
    j = spark.range(int(n_synth)).withColumnRenamed("id", "j")
    j = j.select("j", F.pmod(row_hash(["j"], seed, salt + "b"), F.lit(nb)).alias("idx"),
                 (F.pmod(row_hash(["j"], seed, salt + "n"), F.lit(k)) + 1).cast("int").alias("rank"),
                 hash_uniform(["j"], seed, salt + "g").alias("gap"))
    j = j.join(bases.select("idx", "id", F.col("features").alias("x")), "idx")
    kmax = nbrs.groupBy("id").agg(F.max("rank").alias("_kmax"))
    j = j.join(kmax, "id").withColumn("rank", F.pmod(F.col("rank") - 1, F.col("_kmax")) + 1)
    j = j.join(nbrs.select("id", "rank", "nn_id"), ["id", "rank"])
    j = j.join(feats.select(F.col("id").alias("nn_id"), F.col("features").alias("z")), "nn_id")
    synth = F.zip_with("x", "z", lambda a, b: a + F.col("gap") * (b - a))
    return j.select(synth.alias("features"), F.lit(label_value).alias("target"))


def _counts(df: DataFrame, label: str):
    c = {r[label]: r["n"] for r in class_counts(df, label).collect()}  # two rows
    minority = min(c, key=lambda v: (c[v], v))
    majority = max(c, key=lambda v: (c[v], -v))
    return c, minority, majority


def smote(df: DataFrame, features_col: str = "features", label: str = "target", ratio: float = 0.33,
          k: int = 5, seed: int = 42, id_col: str = "id") -> DataFrame:
    """SMOTE: add ``floor(ratio * n_major) - n_minor`` interpolated minority rows.

    Input rows carry a unique ``id`` and a ``features`` array; neighbours are
    the exact k nearest minority rows (``knn``). Output: original rows plus
    synthetic rows (``is_synthetic = 1``, id NULL).
    """
    from .neighbors import knn

    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(features_col).alias("features"),
                     F.col(label).cast("int").alias("target"))
    c, mino, majo = _counts(base, "target")
    n_synth = int(math.floor(ratio * c[majo])) - c[mino]
    if n_synth <= 0:  # already at or past the requested ratio
        return _combine(base, spark.createDataFrame([], "features array<double>, target int"))
    minority = base.filter(F.col("target") == mino)
    nbrs = knn(minority, minority, k, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)  # read twice
    synth = _interpolate(spark, _indexed(minority, seed), nbrs, minority, n_synth, seed, k, mino, "smote")
    return _combine(base, synth)


def _combine(base: DataFrame, synth: DataFrame) -> DataFrame:
    return (base.withColumn("is_synthetic", F.lit(0))
            .unionByName(synth.withColumn("id", F.lit(None).cast("long")).withColumn("is_synthetic", F.lit(1))))


def _base(df: DataFrame, features_col: str, label: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(features_col).alias("features"),
                     F.col(label).cast("int").alias("target"))


def majority_neighbours(base: DataFrame, minority_label: int, k: int, seed: int = 42) -> DataFrame:
    """Per minority row: how many of its ``k`` nearest rows (any class, exact) are not minority."""
    from .neighbors import knn

    minority = base.filter(F.col("target") == minority_label)
    nn_all = knn(minority, base, k, seed=seed)
    return (nn_all.join(base.select(F.col("id").alias("nn_id"), F.col("target").alias("nt")), "nn_id")
            .groupBy("id").agg(F.count_if(F.col("nt") != minority_label).alias("n_maj")))


def adasyn_allocation(df: DataFrame, features_col: str = "features", label: str = "target", ratio: float = 0.33,
                      k: int = 5, seed: int = 42, id_col: str = "id") -> DataFrame:
    """ADASYN weights: ``r = majority share of the k neighbours``; ``g = rint(r / sum(r) * G)``
    with ``G = floor(ratio * n_major) - n_minor`` (half-to-even rounding, as numpy's rint)."""
    base = _base(df, features_col, label, id_col)
    c, mino, majo = _counts(base, "target")
    g = int(math.floor(ratio * c[majo])) - c[mino]
    share = majority_neighbours(base, mino, k, seed).select("id", (F.col("n_maj") / F.lit(float(k))).alias("r"))
    share = share.persist(StorageLevel.MEMORY_AND_DISK)  # read twice (total, allocation): one search
    total = share.agg(F.sum("r")).first()[0] or 0.0
    if g <= 0 or total == 0:
        return share.withColumn("g", F.lit(0).cast("long"))
    return share.withColumn("g", F.rint(F.col("r") / F.lit(float(total)) * F.lit(float(g))).cast("long"))


def adasyn(df: DataFrame, features_col: str = "features", label: str = "target", ratio: float = 0.33,
           k: int = 5, seed: int = 42, id_col: str = "id") -> DataFrame:
    """ADASYN: synthetic count per minority row proportional to the majority share of its
    k nearest neighbours over all rows; neighbours for interpolation come from the minority."""
    from .neighbors import knn

    base = _base(df, features_col, label, id_col)
    _c, mino, _majo = _counts(base, "target")
    per = adasyn_allocation(df, features_col, label, ratio, k, seed, id_col).filter("g > 0")
    minority = base.filter(F.col("target") == mino)
    nbrs = knn(minority, minority, k, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)  # read twice
    kmax = nbrs.groupBy("id").agg(F.max("rank").alias("_kmax"))
    rows = per.join(kmax, "id").select("id", "_kmax", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"))
    rows = rows.select("id", "j", (F.pmod(row_hash(["id", "j"], seed, "adn"), F.col("_kmax")) + 1).cast("int")
                       .alias("rank"), hash_uniform(["id", "j"], seed, "adg").alias("gap"))
    rows = rows.join(minority.select("id", F.col("features").alias("x")), "id")
    rows = rows.join(nbrs.select("id", "rank", "nn_id"), ["id", "rank"])
    rows = rows.join(minority.select(F.col("id").alias("nn_id"), F.col("features").alias("z")), "nn_id")
    synth = rows.select(F.zip_with("x", "z", lambda a, b: a + F.col("gap") * (b - a)).alias("features"),
                        F.lit(mino).alias("target"))
    return _combine(base, synth)


def borderline_danger(df: DataFrame, features_col: str = "features", label: str = "target", m: int = 10,
                      seed: int = 42, id_col: str = "id") -> DataFrame:
    """Borderline-SMOTE-1 'danger' flags: ``m/2 <= majority among m neighbours < m``."""
    base = _base(df, features_col, label, id_col)
    _c, mino, _majo = _counts(base, "target")
    maj = majority_neighbours(base, mino, m, seed)
    return maj.withColumn("danger", (F.col("n_maj") >= m / 2.0) & (F.col("n_maj") < m))


def borderline_smote(df: DataFrame, features_col: str = "features", label: str = "target", ratio: float = 0.33,
                     k: int = 5, m: int = 10, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Borderline-SMOTE-1: only minority rows in danger are interpolation bases."""
    from .neighbors import knn

    spark = df.sparkSession
    base = _base(df, features_col, label, id_col)
    c, mino, majo = _counts(base, "target")
    n_synth = int(math.floor(ratio * c[majo])) - c[mino]
    if n_synth <= 0:
        return _combine(base, spark.createDataFrame([], "features array<double>, target int"))
    minority = base.filter(F.col("target") == mino)
    danger = borderline_danger(df, features_col, label, m, seed, id_col).filter("danger").select("id")
    danger = danger.persist(StorageLevel.MEMORY_AND_DISK)  # the bases are read several times: one search
    bases = minority.join(danger, "id", "left_semi")
    nbrs = knn(bases, minority, k, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)  # read twice
    synth = _interpolate(spark, _indexed(bases, seed), nbrs, minority, n_synth, seed, k, mino, "border")
    return _combine(base, synth)


def drop_tomek(df: DataFrame, label: str = "target", seed: int = 42) -> DataFrame:
    """Remove both rows of every Tomek link (mutual nearest neighbours of opposite class).

    ``df`` has ``features``, ``target`` and may hold synthetic rows without id;
    every row gets a stable id from its content first.
    """
    from .neighbors import knn

    x = df.withColumn("_rid", F.coalesce(F.col("id"), -1 - row_hash([F.col("features").cast("string"),
                                                                      F.col(label)], seed, "tomek")))
    x = x.persist(StorageLevel.MEMORY_AND_DISK)  # searched, labelled and filtered: the synthetic rows are made once
    pts = x.select(F.col("_rid").alias("id"), "features", F.col(label).alias("t"))
    nn = knn(pts, pts, 1, seed=seed).select("id", "nn_id").persist(StorageLevel.MEMORY_AND_DISK)  # both sides of the links
    mutual = nn.alias("a").join(nn.alias("b"), (F.col("a.id") == F.col("b.nn_id")) & (F.col("a.nn_id") == F.col("b.id")))
    lab = pts.select("id", "t")
    links = (mutual.select(F.col("a.id").alias("id"), F.col("a.nn_id").alias("nn_id"))
             .join(lab, "id").join(lab.select(F.col("id").alias("nn_id"), F.col("t").alias("nt")), "nn_id")
             .filter(F.col("t") != F.col("nt")).select("id"))
    return x.join(links, x._rid == links.id, "left_anti").drop("_rid")


def smote_tomek(df: DataFrame, features_col: str = "features", label: str = "target", ratio: float = 0.33,
                k: int = 5, seed: int = 42, id_col: str = "id") -> DataFrame:
    return drop_tomek(smote(df, features_col, label, ratio, k, seed, id_col), "target", seed)


def balance(df: DataFrame, features_col: str = "features", label: str = "target", path: str = "warning",
            seed: int = 42, id_col: str = "id") -> DataFrame:
    """The two reference balancing recipes behind the B8 guard.

    ``path='warning'``: SMOTE to .5 then undersample to .75 (skipped when
    fewer than 6 minority rows or already at ratio >= .4).
    ``path='daily'``: undersample to 1:10 then SMOTE to .33.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(features_col).alias("features"),
                     F.col(label).cast("int").alias("target"))
    if path == "warning":
        if not needs_balancing(base, "target"):
            return base.withColumn("is_synthetic", F.lit(0))
        up = smote(base, ratio=0.5, seed=seed)
        keyed = up.withColumn("_k", F.coalesce(F.col("id"), -1 - row_hash([F.col("features").cast("string")],
                                                                           seed, "bal")))
        return undersample(keyed, "target", 0.75, seed, key=["_k"]).drop("_k")
    down = undersample(base, "target", 0.1, seed, key=["id"])
    return smote(down, ratio=0.33, seed=seed)
