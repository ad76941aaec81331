"""Bootstraps, ranks and telemetry statistics on tables that aggregation has made small."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequences import running, stored


def clusters(df: DataFrame, by: str, cluster: str, words: str, **errors: str) -> DataFrame:
    """(set, cluster, words, one column of errors for each model): what the bootstraps draw from."""
    return df.groupBy(by, cluster).agg(F.sum(words).alias("words"), *(F.sum(c).alias(n) for n, c in errors.items()))


def paired_bootstrap(table: DataFrame, by: str, cluster: str, a: str, b: str, replicates: int = 10_000, level: float = 0.90, seed: int = 0) -> DataFrame:
    """(delta, lo, hi, resolved) of the mean over sets of the difference in errors per word, with percentile bounds.

    Clusters are drawn with replacement within each set, the same for both models. A set with one cluster has no bounds.
    Sets are drawn in tasks of their own; only the replicates' sums are averaged over sets.
    """

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        w, x, y = (pdf[c].to_numpy(float) for c in ("words", a, b))
        name = int.from_bytes(__import__("hashlib").sha256(str(key[0]).encode()).digest()[:8], "big")
        rng = np.random.default_rng([seed, name])
        point = 100 * (y.sum() - x.sum()) / w.sum()
        out = [point]
        for start in range(0, replicates, 500):
            pick = rng.multinomial(len(w), np.full(len(w), 1 / len(w)), size=min(500, replicates - start))
            out.extend(100 * (pick @ (y - x)) / (pick @ w))
        return pd.DataFrame({"replicate": np.arange(-1, replicates), "delta": out, "alone": len(w) < 2})

    drawn = table.groupBy(by).applyInPandas(draw, "replicate long, delta double, alone boolean")
    means = drawn.groupBy("replicate").agg(F.avg("delta").alias("delta"), F.max("alone").alias("alone"))
    tail = (1 - level) / 2
    bounds = means.agg(
        F.max(F.when(F.col("replicate") < 0, F.col("delta"))).alias("delta"), F.max("alone").alias("alone"),
        F.expr(f"percentile(if(replicate >= 0, delta, null), {tail})").alias("lo"), F.expr(f"percentile(if(replicate >= 0, delta, null), {1 - tail})").alias("hi"),
    )
    return bounds.select("delta", *(F.when(~F.col("alone"), F.col(c)).alias(c) for c in ("lo", "hi"))).withColumn("resolved", F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False)))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties counting half: from counts by score, so equal scores meet in partial sums."""
    by = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    run = running(by, "n", "below", score)
    return run.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc"))


def counter_rates(df: DataFrame, counter: str, ts: str, by: str, wrap: float, per: float = 1.0, then: tuple[str, ...] = ()) -> DataFrame:
    """``delta`` (a counter that falls has wrapped) and ``rate`` (null if time stood still) for each ``per`` units of ``ts``.

    Whole numbers of small units keep short steps exact, which seconds since 1970 don't. Readings of one time follow ``then``.
    """
    w = W.partitionBy(by).orderBy(ts, *then)
    before, seconds = F.lag(counter).over(w), (F.col(ts) - F.lag(ts).over(w)) / per
    delta = F.when(F.col(counter) < before, F.col(counter) + wrap - before).otherwise(F.col(counter) - before)
    return df.withColumn("delta", delta).withColumn("rate", F.when(seconds > 0, delta / seconds))


def trapezoid(df: DataFrame, ts: str, value: str, by: str) -> DataFrame:
    """The integral of each series by trapezoids."""
    w = W.partitionBy(by).orderBy(ts)
    part = (F.col(ts) - F.lag(ts).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return df.withColumn("part", part).groupBy(by).agg(F.sum("part").alias("integral"), F.count("*").alias("n"))


def breaker(df: DataFrame, value: str, ts: str, by: str, window: int = 5, factor: float = 2.0, patience: int = 3) -> DataFrame:
    """(by, tripped_at): where ``patience`` readings in a row exceed ``factor`` times the least rolling median so far.

    Suspect readings don't enter the window; a window counts once it is full.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, base, bad, at = [], math.inf, 0, None
        for t, v in pdf.sort_values(ts)[[ts, value]].itertuples(index=False):
            if v > factor * base:
                bad += 1
                if bad >= patience:
                    at = t
                    break
                continue
            bad = 0
            held = [*held, v][-window:]
            if len(held) == window:
                base = min(base, float(np.median(held)))
        return pd.DataFrame({by: [key[0]], "tripped_at": [at]}).astype({"tripped_at": "float64"})

    return df.groupBy(by).applyInPandas(run, f"`{by}` {df.schema[by].dataType.simpleString()}, tripped_at double")


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table of counts."""
    n, r, k = a + b + c + d, a + b, a + c
    logs = lambda x: math.lgamma(x + 1)
    p = lambda x: math.exp(logs(r) + logs(n - r) + logs(k) + logs(n - k) - logs(n) - logs(x) - logs(r - x) - logs(k - x) - logs(n - r - k + x))
    here = p(a)
    return min(1.0, sum(q for x in range(max(0, r + k - n), min(r, k) + 1) if (q := p(x)) <= here * (1 + 1e-9)))


def upper_bound(successes: int, n: int, level: float = 0.95) -> float:
    """Clopper-Pearson upper bound of a share, by bisection."""
    if successes >= n:
        return 1.0
    below = lambda p: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(successes + 1))
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > 1 - level else (lo, mid)
    return hi


def schedule(step, warmup: int, total: int, decay: int, peak: float):
    """Warm-up, stable, linear decay."""
    return F.when(step < warmup, peak * (step + 1) / warmup).when(step < total - decay, F.lit(peak)).otherwise(F.greatest(peak * (total - step) / decay, F.lit(0.0)))


#: Cumulative probabilities of a Poisson variable of mean 1.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def poisson_sql(unit: str, rep: str, engine: str = "spark") -> str:
    """SQL of a unit's weight in a bootstrap replicate: a Poisson draw by hash, the same wherever the rows are."""
    cases = "case " + " ".join(f"when x < {c} then {k}" for k, c in enumerate(POISSON)) + f" else {len(POISSON)} end"
    if engine == "duck":
        return f"[{cases} for x in [('0x' || substr(md5({unit} || ':' || {rep}), 1, 7))::bigint / 268435456.0]][1]"
    return f"transform(array(md5(concat({unit}, ':', {rep}))), x -> {poisson_of('x')})[0]"


def poisson_of(digest: str) -> str:
    """SQL of the weight that an MD5 in hex digits stands for: digits are ordered as their numbers are, so none is converted."""
    return "case " + " ".join(f"when {digest} < '{math.ceil(c * 2**28):07x}' then {k}" for k, c in enumerate(POISSON)) + f" else {len(POISSON)} end"


def poisson_drawn(units: DataFrame, unit: str, replicates: int) -> DataFrame:
    """Each unit with ``rep`` (from 0) and its weight ``k`` in that replicate, as ``poisson_sql`` gives it.

    Rows are dealt out before they grow to many times their number: small tables would all be in a few tasks.
    """
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = units.withColumn("__unit", F.concat(F.col(unit).cast("string"), F.lit(":"))).repartition(tasks)
    rows = named.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = rows.withColumn("__digest", F.expr("md5(concat(__unit, rep))"))
    return rows.withColumn("k", F.expr(poisson_of("__digest"))).drop("__unit", "__digest")


def crossed_bootstrap(df: DataFrame, clip: str, replicate: str, value: str, draws: int = 200, most: int = 1000) -> DataFrame:
    """(draw, statistic): the median over clips of their means over replicates, both drawn anew; draw -1 is the sample itself.

    A clip's and a replicate's weights in a draw are two independent draws by hash, so nothing is joined for resampling: a clip's
    means of all draws come from its own short array of replicates, and medians count each mean by its clip's weight. There may
    be ``most`` replicates, which are the inner, short dimension; more are refused. Draws in which a side has no weight are null.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(clip).cast("string").alias("c"), F.col(replicate).cast("string").alias("r")).agg(F.avg(value).alias("v"))
    by_clip = cells.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("cells"))
    by_clip = by_clip.withColumn("cells", F.when(F.size("cells") <= most, F.col("cells")).otherwise(F.raise_error(F.lit(f"more than {most} replicates"))))
    rows = by_clip.withColumn("b", F.explode(F.expr(f"sequence(-1L, {draws - 1}L)")))
    draw = lambda unit: f"if(b < 0, 1, {poisson_sql(unit, 'cast(b as string)')})"
    one = draw("concat('r', x.r)")
    mean = f"try_divide(aggregate(cells, 0.0D, (a, x) -> a + {one} * x.v), aggregate(cells, 0.0D, (a, x) -> a + {one}))"
    rows = rows.select("b", F.expr(mean).alias("m"), F.expr(f"cast({draw("concat('c', c)")} as long)").alias("w"))
    drawn = rows.groupBy("b").agg(F.percentile(F.when(F.col("w") > 0, F.col("m")), F.lit(0.5), F.greatest("w", F.lit(1))).alias("statistic"))
    return drawn.withColumnRenamed("b", "draw")


def variance_components(df: DataFrame, row: str, column: str, value: str, floor: float = 0.0) -> DataFrame:
    """(sigma_row, sigma_column, sigma_noise) of a complete two-way table, by moments; what isn't above ``floor`` is 0.

    Means are sums by key and the residuals come from one join each, so the table's cells stay spread.
    """
    r = df.groupBy(row).agg(F.avg(value).alias("__r"))
    c = df.groupBy(column).agg(F.avg(value).alias("__c"))
    whole = df.agg(F.avg(value).alias("__m"), F.count_distinct(row).alias("__nr"), F.count_distinct(column).alias("__nc"))
    cells = df.join(r, row).join(c, column).join(F.broadcast(whole))
    n_r, n_c = F.max("__nr"), F.max("__nc")
    # each row's mean occurs once for each column, so sums over cells hold the factor already
    ms_r = F.sum(F.pow(F.col("__r") - F.col("__m"), 2)) / (n_r - 1)
    ms_c = F.sum(F.pow(F.col("__c") - F.col("__m"), 2)) / (n_c - 1)
    ms_e = F.sum(F.pow(F.col(value) - F.col("__r") - F.col("__c") + F.col("__m"), 2)) / ((n_r - 1) * (n_c - 1))
    above = lambda x: F.when(x > floor, x).otherwise(F.lit(0.0))
    return cells.agg(above(F.sqrt(ms_r / n_c)).alias("sigma_row"), above(F.sqrt(ms_c / n_r)).alias("sigma_column"), above(F.sqrt(ms_e)).alias("sigma_noise"))


def power_law(points: DataFrame, x: str, y: str) -> DataFrame:
    """(n, exponent, factor, withheld, predicted, off): y = factor * x ** exponent by least squares of the logarithms of all
    points but the one of the greatest x, and how far the fit is off there."""
    last = points.agg(F.max(F.struct(x, y)).alias("l")).select(F.col(f"l.{x}").alias("lx"), F.col(f"l.{y}").alias("ly"))
    logs = points.join(F.broadcast(last)).where(F.col(x) < F.col("lx")).select("lx", "ly", F.ln(x).alias("a"), F.ln(y).alias("b"))
    fit = logs.groupBy("lx", "ly").agg(F.count("*").alias("n"), F.regr_slope("b", "a").alias("exponent"), F.exp(F.regr_intercept("b", "a")).alias("factor"))
    predicted = F.col("factor") * F.pow("lx", "exponent")
    return fit.select("n", "exponent", "factor", F.col("ly").alias("withheld"), predicted.alias("predicted"), (predicted / F.col("ly") - 1).alias("off"))


def pareto(df: DataFrame, key: str, *dims: str) -> DataFrame:
    """Keys of the rows that no other row matches in every dimension and exceeds in one.

    Each task leaves out what its own rows dominate, and the fronts of eight tasks are merged by one, again and again, so that
    the last task holds no more than the result and what seven others left. A row with a null is left out.
    """

    def front(batches):
        held = None
        for pdf in batches:
            pdf = pdf.dropna(subset=list(dims))
            held = pdf if held is None else pd.concat([held, pdf])
            x = held[list(dims)].to_numpy(float)
            order, kept = np.lexsort(x.T)[::-1], np.zeros((0, len(dims)))  # what dominates a row comes before it
            stays = []
            for i in order:
                if not ((kept >= x[i]).all(axis=1) & (kept > x[i]).any(axis=1)).any():
                    stays.append(i)
                    kept = np.vstack([kept, x[i]])
            held = held.iloc[stays]
        if held is not None:
            yield held

    p = df.select(key, *dims)
    p = stored(p.mapInPandas(front, p.schema))
    parts = p.select(F.spark_partition_id().alias("part")).distinct().count()
    while parts > 1:
        parts = -(-parts // 8)
        p = stored(p.coalesce(parts).mapInPandas(front, p.schema))
    return p.select(key)


def set_identity(df: DataFrame, by: str, key: str) -> DataFrame:
    """(by, identity): SHA-256 of each group's sorted keys, a line each. Keys stream through the hash, none is held."""
    import hashlib

    def digest(batches):
        now, state = None, None
        for pdf in batches:
            out = []
            for group, part in pdf.groupby(by, sort=False, dropna=False):
                body = "\n".join(part[key].astype(str))
                if state is not None and group == now:
                    state.update(("\n" + body).encode())
                else:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = group, hashlib.sha256(body.encode())
            yield pd.DataFrame(out, columns=[by, "identity"])
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=[by, "identity"])

    rows = df.select(by, key).where(F.col(by).isNotNull() & F.col(key).isNotNull()).repartition(F.col(by)).sortWithinPartitions(by, key)
    return rows.mapInPandas(digest, f"`{by}` {df.schema[by].dataType.simpleString()}, identity string")


def harm_screen(spans: DataFrame, group: str, label_set: str, original: str, cleaned: str, least: int, exempt=None) -> DataFrame:
    """(group, label_set, aligned, original, cleaned, judged, harm, disabled): changed spans by group and label set, and pooled as
    ``both``.

    A cell of at least ``least`` spans is judged; it shows harm if the original matched more often than the cleaned text. A group
    with any such cell is disabled, unless it is ``exempt`` (a condition on the group). Null counts as no match.
    """
    hit = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    cells = spans.groupBy(group, label_set).agg(F.count("*").alias("aligned"), hit(original), hit(cleaned))
    pooled = cells.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("aligned", original, cleaned))).withColumn(label_set, F.lit("both"))
    every = cells.unionByName(pooled).withColumn("judged", F.col("aligned") >= least)
    every = every.withColumn("harm", F.col("judged") & (F.col(original) > F.col(cleaned)))
    any_ = F.max("harm").over(W.partitionBy(group))  # a row for each label set
    told = any_ if exempt is None else any_ & ~exempt
    return every.withColumn("disabled", told).withColumnsRenamed({original: "original", cleaned: "cleaned"})


def exposure(tape: DataFrame, domain: str, key: str, size: str, order: list[str], batch: int) -> DataFrame:
    """(domain, presentations, size, unique_ids, padded): what a tape presents of each domain; ``padded`` is the size of all its
    batches of ``batch`` rows in ``order``, each row as long as the batch's longest, and the same for every domain."""
    from .sequences import ranked

    batches = ranked(tape.select(size, *order), *order).groupBy(F.expr(f"rank div {batch}")).agg((F.max(size) * F.count("*")).alias("p"))
    padded = batches.agg(F.sum("p").alias("padded"))  # one row
    by_key = tape.groupBy(domain, key).agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    out = by_key.groupBy(domain).agg(F.sum("n").alias("presentations"), F.sum("s").alias("size"), F.count("*").alias("unique_ids"))
    return out.crossJoin(F.broadcast(padded))


def token_rates(df: DataFrame, by: str, tokens: str, seconds: str, frames: float) -> DataFrame:
    """Tokens a second as ratio of sums and as mean of ratios, and the share of rows with more tokens than whole nominal frames."""
    more = F.when(F.col(tokens) > F.floor(F.col(seconds) * frames), 1.0).otherwise(0.0)
    return df.groupBy(by).agg(
        F.count("*").alias("clips"), F.round(F.try_divide(F.sum(tokens), F.sum(seconds)), 9).alias("tokens_per_second"),
        F.round(F.avg(F.try_divide(F.col(tokens), F.col(seconds))), 9).alias("mean_rate"), F.round(F.avg(more), 9).alias("over_frames"),
    )
