"""Persistent-scatterer time series: periodograms and temporal statistics on long tables (ps, t, phi)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(spark, axes: dict[str, list[float]]) -> DataFrame:
    """All combinations of the axes, first axis fastest, numbered by ``idx``. Its size is the product of the given lists'."""
    df, before = None, None
    for name, values in axes.items():
        axis = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"__i_{name} int, {name} double")
        df = axis if df is None else df.crossJoin(axis)
        index = F.col(f"__i_{name}") if before is None else before[0] + F.col(f"__i_{name}") * before[1]
        before = (index, len(values) * (1 if before is None else before[1]))
    return df.withColumn("idx", before[0].cast("int")).drop(*(f"__i_{n}" for n in axes))


def _valid() -> Column:
    return F.col("phi").isNotNull() & ~F.isnan("phi")


def periodogram(series: DataFrame, features: dict[str, str], axes: DataFrame, key: str = "ps", weight: str | None = None) -> DataFrame:
    """For each ``key`` the grid point of largest coherence of phi against sum(parameter * feature), first on ties; with ``weight``, a column, of the coherence weighted by it.

    A key's samples are gathered into one array (its acquisitions, some hundred), so the grid is
    searched by matrix products in the worker: the shuffle is one row a key, not one a key and grid point. Null and NaN phases weigh 0
    and don't count in n, nor do samples without a weight above 0; gamma is null where no other is left.
    """
    own = list(features.values())
    heavy = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sample = F.struct(F.col("phi").cast("double").alias("phi"), heavy.alias("__w"), *(F.col(f).cast("double").alias(f) for f in own))
    gathered = series.groupBy(key).agg(F.collect_list(F.when(_valid() & (heavy > 0), sample)).alias("obs"))
    nodes = sorted(axes.select("idx", *features).collect())  # the grid, of given size
    kind = dict(gathered.dtypes)[key]

    def search(batches):
        import numpy as np
        import pyarrow as pa

        grid_of = np.array([r[1:] for r in nodes], float).reshape(len(nodes), len(features))
        for batch in batches:
            obs = batch.column(1)
            ends = np.asarray(obs.offsets)
            flat = obs.values  # the batch's samples, one behind the other
            phi, heavy = np.asarray(flat.field("phi")), np.asarray(flat.field("__w"))
            at = np.stack([np.asarray(flat.field(f)) for f in own], 1) if own else np.zeros((len(phi), 0))
            found = []
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if hi == lo:
                    found.append((0, None, nodes[0]))
                    continue
                turned = np.exp(1j * (phi[lo:hi, None] - at[lo:hi] @ grid_of.T))
                gamma = np.round(np.abs(turned.sum(axis=0) if weight is None else heavy[lo:hi] @ turned) / (hi - lo if weight is None else heavy[lo:hi].sum()), 6)
                best = int(gamma.argmax())
                found.append((int(hi - lo), float(gamma[best]), nodes[best]))
            columns = [batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([g for _, g, _ in found], pa.float64()), pa.array([r[0] for _, _, r in found], pa.int32())]
            columns += [pa.array([float(r[1 + k]) for _, _, r in found], pa.float64()) for k in range(len(features))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "gamma", "idx", *features])

    return gathered.mapInArrow(search, f"{key} {kind}, n long, gamma double, idx int" + "".join(f", {p} double" for p in features))


def dispersion(series: DataFrame, amplitude: str = "amp", key: str = "ps") -> DataFrame:
    """Population deviation over mean."""
    return series.groupBy(key).agg(F.count("*").alias("n"), (F.stddev_pop(amplitude) / F.avg(amplitude)).alias("da"))


def daily_phase(events: DataFrame) -> DataFrame:
    """ps, day, phi (circular mean) and amp (mean) of events (user_id, ts, value)."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return events.groupBy(F.col("user_id").alias("ps"), day.alias("day")).agg(F.atan2(F.sum(F.sin("value")), F.sum(F.cos("value"))).alias("phi"), F.avg("value").alias("amp"))


def latest_first(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("rank") <= n)


def planar(series: DataFrame, axes: DataFrame, key: str = "t") -> DataFrame:
    """For each ``key`` (a date) the plane (sx, sy) of largest coherence over samples (x, y, phi), first on ties.

    A date has as many samples as there are scatterers, so each sample adds to the sums of every grid node in
    partial aggregates; what is shuffled is one row a date and node from each task. Null and NaN phases weigh 0 and don't count in n.
    """
    turned = F.when(_valid(), F.col("phi") - (F.col("sx") * F.col("x") + F.col("sy") * F.col("y")))
    sums = series.crossJoin(F.broadcast(axes)).groupBy(key, "idx", "sx", "sy").agg(F.count(turned).alias("n"), F.sum(F.cos(turned)).alias("c"), F.sum(F.sin(turned)).alias("s"))
    gamma = F.round(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.nullif("n", F.lit(0)), 6)
    best = sums.groupBy(key).agg(F.max(F.struct(gamma.alias("gamma"), (-F.col("idx")).alias("back"), "n", "idx", "sx", "sy", F.atan2("s", "c").alias("bias"))).alias("b"))
    return best.select(key, "b.n", "b.gamma", "b.idx", "b.sx", "b.sy", "b.bias")


def refined(series: DataFrame, coarse: DataFrame, features: dict[str, str], steps: dict[str, float], key: str = "ps") -> DataFrame:
    """``coarse`` (key, parameters) climbed from its grid node to the peak of coherence, at most one grid step away.

    Newton steps, halved until coherence grows; a key's samples are its acquisitions, so one group is small.
    """
    names, kinds = list(features), dict(series.dtypes)
    met = series.select(key, "phi", *features.values()).join(coarse.select(key, *(F.col(n).alias(f"__{n}") for n in names)), key)

    def climb(pdf):
        import numpy as np
        import pandas as pd

        f, phi = pdf[list(features.values())].to_numpy(float), pdf["phi"].to_numpy(float)
        f, phi = f[~np.isnan(phi)], phi[~np.isnan(phi)]
        start = pdf[[f"__{n}" for n in names]].iloc[0].to_numpy(float)
        reach = np.array([steps[n] for n in names])

        def power(x):
            z = np.exp(1j * (phi - f @ x))
            return abs(z.sum()) ** 2, z

        x, (best, z) = start, power(start)
        for _ in range(50):
            s, d = z.sum(), -1j * (f.T @ z)
            slope = 2 * (np.conj(s) * d).real
            bend = 2 * (np.conj(d)[:, None] * d[None, :] - np.conj(s) * ((f * z[:, None]).T @ f)).real
            scale = np.abs(np.linalg.eigvalsh(bend)).max() or 1.0
            move = np.linalg.solve(-bend, slope) if np.linalg.eigvalsh(-bend).min() > 1e-9 * scale else slope / scale
            for _ in range(30):
                there = np.clip(x + move, start - reach, start + reach)
                value, turned = power(there)
                if value > best:
                    break
                move = move / 2
            else:
                break
            gain, x, best, z = value - best, there, value, turned
            if gain < 1e-13 * best:
                break
        return pd.DataFrame([[pdf[key].iloc[0], *x, np.sqrt(best) / max(1, len(phi))]], columns=[key, *names, "gamma"])

    return met.groupBy(key).applyInPandas(climb, f"{key} {kinds[key]}, " + ", ".join(f"{n} double" for n in names) + ", gamma double")


def alternated(series: DataFrame, places: DataFrame, features: dict[str, str], ps_grid: DataFrame, plane_grid: DataFrame, limits: dict[str, float], checkpoint, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Planes of each date and rates of each scatterer, estimated in turn until rates change less than ``limits`` or rounds end.

    ``series`` is (ps, t, phi, features), ``places`` (ps, x, y); ``checkpoint`` cuts a table's lineage. One scalar row
    a round reaches the driver. Returned are (t, sx, sy, bias, ...) and (ps, parameters, gamma).
    """
    own = list(features)
    data = checkpoint(series.join(places, "ps"))
    rates, planes = None, None
    for _ in range(rounds):
        if rates is None:
            left = data
        else:
            model = sum((F.col(p) * F.col(f) for p, f in features.items()), F.lit(0.0))
            left = data.join(rates.select("ps", *own), "ps").withColumn("phi", F.col("phi") - model)
        planes = checkpoint(planar(left.select("t", "x", "y", "phi"), plane_grid))
        flat = data.join(F.broadcast(planes.select("t", "sx", "sy", "bias")), "t")  # a row a date
        flat = flat.withColumn("phi", F.col("phi") - F.col("sx") * F.col("x") - F.col("sy") * F.col("y") - F.col("bias"))
        now = checkpoint(periodogram(flat, features, ps_grid))
        if rates is not None:
            moved = rates.select("ps", *(F.col(p).alias(f"__{p}") for p in own)).join(now, "ps").agg(*(F.max(F.abs(F.col(p) - F.col(f"__{p}"))).alias(p) for p in own)).first()
            if all(moved[p] is None or moved[p] < limits[p] for p in own):
                return planes, now
        rates = now
    return planes, rates


def full(series: DataFrame, places: DataFrame, features: dict[str, str], ps_grid: DataFrame, plane_grid: DataFrame, limits: dict[str, float], steps: dict[str, float], checkpoint, dispersion_below: float = 0.25, gamma_above: float = 0.9) -> DataFrame:
    """Persistent scatterers of ``series`` (ps, t, phi, amp, features): stable amplitudes, planes removed, rates refined, coherent ones kept.

    ps, parameters, gamma of those whose coherence exceeds ``gamma_above``.
    """
    chosen = checkpoint(series.join(dispersion(series).where(F.col("da") < dispersion_below).select("ps"), "ps", "left_semi"))
    planes, rates = alternated(chosen.drop("amp"), places, features, ps_grid, plane_grid, limits, checkpoint)
    flat = chosen.join(places, "ps").join(F.broadcast(planes.select("t", "sx", "sy", "bias")), "t")
    flat = flat.withColumn("phi", F.col("phi") - F.col("sx") * F.col("x") - F.col("sy") * F.col("y") - F.col("bias"))
    return refined(flat, rates, features, steps).where(F.col("gamma") > gamma_above)
