"""Out-of-fold ridge for several choices of inputs: all folds, penalties and inputs in one recurrence over sparse cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import temporary, written
from .text import group_folds

ALPHAS = (0.3, 1.0, 3.0, 10.0, 30.0)


def held_out(k: int) -> dict[str, tuple[int, int]]:
    """Settings by name: folds f <= g that are held out (f = g: one)."""
    return {f"{f}_{g}": (f, g) for f in range(k) for g in range(f, k)}


def text_cells(rows: DataFrame, key: str, block: str, grams: Column, k: int, min_df: int = 2) -> DataFrame:
    """(block, key, feature, w0_0..): TF-IDF weights of a text, one for each setting of `held_out`.

    A weight has the vocabulary and document frequencies of the rows outside the held-out folds, and
    length 1 a row (0 if the row has no known gram). A null text has no cells.
    """
    settings = held_out(k)
    tf, _ = written(rows.select(key, "fold", F.explode(grams).alias("feature")).groupBy(key, "fold", "feature").agg(F.count("*").alias("tf")), "fold-tf")
    inside = {t: f"fold NOT IN ({f}, {g})" for t, (f, g) in settings.items()}
    counts = tf.groupBy("feature").agg(*[F.expr(f"count_if({c}) AS df{t}") for t, c in inside.items()])
    sizes = rows.agg(*[F.expr(f"count_if({c}) AS n{t}") for t, c in inside.items()])
    raw = tf.join(counts, "feature").crossJoin(F.broadcast(sizes))
    raw = raw.selectExpr(key, "feature", *[f"CASE WHEN df{t} >= {min_df} THEN (1 + ln(tf)) * (ln((1 + n{t}) / (1 + df{t})) + 1) ELSE 0D END AS w{t}" for t in settings])
    lengths = raw.groupBy(key).agg(*[F.expr(f"sqrt(sum(w{t} * w{t})) AS l{t}") for t in settings])
    unit = [f"coalesce(try_divide(w{t}, l{t}), 0D) AS w{t}" for t in settings]
    return raw.join(lengths, key).selectExpr(f"'{block}' AS block", key, "feature", *unit).where(" OR ".join(f"w{t} <> 0" for t in settings))


def category_cells(rows: DataFrame, key: str, block: str, columns: list[str], k: int) -> DataFrame:
    """1 for each category of a row that rows outside the held-out folds have too; null has no cell."""
    each = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
    long = rows.select(key, "fold", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("feature"))
    known = long.groupBy("feature").agg(*[F.expr(f"CAST(count_if(fold NOT IN ({f}, {g})) > 0 AS DOUBLE) AS w{t}") for t, (f, g) in held_out(k).items()])
    return long.join(known, "feature").select(F.lit(block).alias("block"), key, "feature", *[f"w{t}" for t in held_out(k)])


def number_cells(rows: DataFrame, key: str, block: str, columns: list[str], k: int) -> DataFrame:
    """Numbers as they are; null counts as 0."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("w")) for c in columns])
    long = rows.select(key, F.explode(each).alias("_e")).select(key, "_e.*").where("w <> 0")
    return long.select(F.lit(block).alias("block"), key, "feature", *[F.col("w").alias(f"w{t}") for t in held_out(k)])


class Recurrence:
    """Lanczos coefficients of every variant and setting at once, and the solutions for all penalties in its vectors."""

    def __init__(self, shape: tuple[int, int], alphas: tuple[float, ...], tol: float, most: int) -> None:
        self.shape, self.penalty, self.tol, self.most = shape, np.array(alphas), tol, most
        self.active, self.first, self.worst = np.ones(shape, bool), None, np.zeros((*shape, len(alphas)))
        self.steps: list[tuple] = []  # (scale, mean, off-diagonal, pivot, right side) of each pass

    def take(self, rr: np.ndarray, rz: np.ndarray, zm: np.ndarray) -> tuple | None:
        """rr, rz: r'r and r'z of the vector r and z = X X' r; zm: the mean of z. (scale, mean, diagonal, off-diagonal) of the next vector, None at the end."""
        length = np.sqrt(rr)
        if self.first is None:
            self.first, self.active = length, length > 0
        else:
            pivot, right = self.steps[-1][3:]
            now = length[..., None] * np.abs(right / pivot) / np.where(self.first > 0, self.first, 1)[..., None]
            self.worst = np.where(self.active[..., None], now, self.worst)
            self.active = self.active & (self.worst.max(axis=2) > self.tol)
        if not self.active.any() or len(self.steps) == self.most:
            return None
        scale = np.where(self.active, 1 / np.where(self.active, length, 1), 0.0)
        diagonal, off = rz * scale**2, np.where(self.active, length, 0.0) if self.steps else np.zeros(self.shape)
        pivot = diagonal[..., None] + self.penalty
        right = np.where(self.active, self.first, 0.0)[..., None] * np.ones(len(self.penalty))
        if self.steps:
            pivot = pivot - off[..., None] ** 2 / self.steps[-1][3]
            right = -off[..., None] * self.steps[-1][4] / self.steps[-1][3]
        self.steps.append((scale, zm, off, pivot, right))
        return scale, zm, diagonal, off

    def weights(self) -> list[np.ndarray]:
        """Back substitution: coefficients of the passes' z, by variant, setting and penalty."""
        weights, later = [], None
        for j in reversed(range(len(self.steps))):
            scale, _, _, pivot, right = self.steps[j]
            later = right / pivot if later is None else (right - self.steps[j + 1][2][..., None] * later) / pivot
            weights.insert(0, later * scale[..., None])
        return weights

    def offset(self, y_mean: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        return y_mean[None, :, None] - sum((w * self.steps[j][1][..., None] for j, w in enumerate(weights)), np.zeros((*self.shape, len(self.penalty))))


def with_penalties(made: DataFrame, names: list[str], key: str, y: str, k: int, alphas: tuple[float, ...], worst: np.ndarray) -> DataFrame:
    """The penalty of each variant and fold by the errors inside the other folds, and its predictions. made: (variant, key, fold, y, _a, _p0..), predictions with each fold held out."""
    spark, place = made.sparkSession, {t: i for i, t in enumerate(held_out(k))}
    made, _ = written(made.withColumn("alpha", F.array(*map(F.lit, map(float, alphas)))[F.col("_a")]), "fold-predictions")
    errors = made.groupBy("variant", "alpha").agg(F.array(*[F.expr(f"sum(power(_p{f} - {y}, 2)) FILTER (WHERE fold <> {f})") for f in range(k)]).alias("_e"))
    chosen = errors.select("variant", "alpha", F.posexplode("_e").alias("fold", "_sse")).groupBy("variant", "fold").agg(F.min_by("alpha", F.struct("_sse", "alpha")).alias("alpha"))
    left = spark.createDataFrame([(v, f, float(a), float(worst[i, place[f"{f}_{f}"], j])) for i, v in enumerate(names) for f in range(k) for j, a in enumerate(alphas)], "variant string, fold int, alpha double, residual double")
    test = made.select("variant", key, "fold", y, "alpha", F.array(*[f"_p{f}" for f in range(k)])[F.col("fold")].alias("yhat"))
    return test.join(F.broadcast(chosen), ["variant", "fold", "alpha"]).join(F.broadcast(left), ["variant", "fold", "alpha"]).select("variant", key, "fold", y, "alpha", "yhat", "residual")


def ridge_over_folds(rows: DataFrame, cells: DataFrame, key: str, y: str, variants: dict[str, list[str]], k: int = 5, alphas: tuple[float, ...] = ALPHAS, tol: float = 1e-6, most: int = 100) -> DataFrame:
    """(variant, key, fold, y, alpha, yhat, residual): out-of-fold predictions of ridge with intercept on the cells of each variant's blocks.

    rows: (key, fold, y), y not null; cells: (block, key, feature, w0_0..), a weight for each setting of
    `held_out`. For fold f held out, the penalty is the one of smallest squared error over the other
    folds g, each predicted from the rows outside f and g (the smallest penalty on ties).

    A variant and setting runs a Lanczos recurrence on X X', centred on its own rows. A pass over the
    cells serves all of them (two joins with map-side sums), and the same vectors solve all
    penalties, so neither folds nor penalties refit. Only a few numbers a setting reach the driver.
    A setting stops when its relative residual is below tol for every penalty, or after `most` passes:
    small penalties need the most, and count as fits stopped early then. residual is that of the fit
    a row is predicted by; its fitted values are off by at most residual times the deviation of y
    (root mean square over the fit's rows).
    """
    spark, settings, names = rows.sparkSession, held_out(k), sorted(variants)
    inside = {t: f"fold NOT IN ({f}, {g})" for t, (f, g) in settings.items()}
    means = rows.agg(*[F.expr(f"avg({y}) FILTER (WHERE {c})") for c in inside.values()]).first()
    y_mean = np.array([np.nan if m is None else m for m in means])
    blocks = spark.createDataFrame([(b, v) for v in names for b in variants[v]], "block string, variant string")  # a row a block of a variant

    start = [F.when(F.expr(c), F.col(y) - float(y_mean[i])).otherwise(0.0).alias(f"r{t}") for i, (t, c) in enumerate(inside.items())]
    state = rows.select(F.explode(F.array(*map(F.lit, names))).alias("variant"), key, "fold", y, *start, *[F.lit(0.0).alias(f"p{t}") for t in settings])
    shape = (len(names), len(settings))
    lanczos, passes = Recurrence(shape, alphas, tol, most), []  # written tables of the passes
    for _ in range(most + 1):
        sums = cells.join(F.broadcast(blocks), "block").join(state.select("variant", key, *[f"r{t}" for t in settings]), ["variant", key])
        sums = sums.groupBy("variant", "block", "feature").agg(*[F.expr(f"sum(w{t} * r{t}) AS t{t}") for t in settings])
        z = cells.join(sums, ["block", "feature"]).groupBy("variant", key).agg(*[F.expr(f"sum(w{t} * t{t}) AS z{t}") for t in settings])
        table, _ = written(state.join(z, ["variant", key], "left").fillna(0.0, [f"z{t}" for t in settings]), "lanczos")
        figures = ", ".join(f"sum(r{t} * r{t}), sum(r{t} * z{t}), avg(z{t}) FILTER (WHERE {c})" for t, c in inside.items())
        got = {r["variant"]: r["_f"] for r in table.groupBy("variant").agg(F.expr(f"array({figures}) AS _f")).collect()}
        if not got:
            break
        rr, rz, zm = np.moveaxis(np.array([got[v] for v in names], dtype=float).reshape(*shape, 3), 2, 0)
        step = lanczos.take(rr, rz, np.nan_to_num(zm))
        if step is None:
            break
        scale, mean, diagonal, off = step
        passes.append(table)
        numbers = spark.createDataFrame([(v, scale[i].tolist(), (mean[i] * scale[i]).tolist(), diagonal[i].tolist(), off[i].tolist()) for i, v in enumerate(names)], "variant string, _s array<double>, _m array<double>, _d array<double>, _o array<double>")
        following = []
        for i, (t, c) in enumerate(inside.items()):
            following.append(f"CASE WHEN _s[{i}] > 0 AND {c} THEN z{t} * _s[{i}] - _m[{i}] - _d[{i}] * r{t} * _s[{i}] - _o[{i}] * p{t} ELSE 0D END AS r{t}")
            following.append(f"r{t} * _s[{i}] AS p{t}")
        state = table.join(F.broadcast(numbers), "variant").selectExpr("variant", key, "fold", y, *following)

    weights = lanczos.weights()
    offset = lanczos.offset(y_mean, weights)
    # of a row in fold h: the prediction with f and h held out (f = h: its own)
    at = [[f"{min(f, h)}_{max(f, h)}" for h in range(k)] for f in range(k)]
    place = {t: i for i, t in enumerate(settings)}

    def grid(m: np.ndarray) -> list[tuple]:
        return [(v, a, [[float(m[i, place[t], a]) for t in line] for line in at]) for i, v in enumerate(names) for a in range(len(alphas))]

    schema = "variant string, _a int, _c array<array<double>>"
    # a row a variant and penalty each
    parts = [rows.select(key, "fold", y).crossJoin(F.broadcast(spark.createDataFrame(grid(offset), schema))).selectExpr("variant", key, "fold", y, "_a", *[f"_c[{f}][fold] AS _p{f}" for f in range(k)])]
    for j, table in enumerate(passes):
        each = table.join(F.broadcast(spark.createDataFrame(grid(weights[j]), schema)), "variant")
        parts.append(each.selectExpr("variant", key, "fold", y, "_a", *[f"_c[{f}][fold] * array({', '.join(f'z{t}' for t in at[f])})[fold] AS _p{f}" for f in range(k)]))
    made = reduce(DataFrame.unionByName, parts).groupBy("variant", key, "fold", y, "_a").agg(*[F.sum(f"_p{f}").alias(f"_p{f}") for f in range(k)])
    return with_penalties(made, names, key, y, k, alphas, lanczos.worst)


#: Numbers of feature vectors that the driver holds at most (512 MB): those of all passes. With more features the passes are joins.
MOST_NUMBERS = 1 << 26
#: Rows whose cells a task unfolds at once.
ROWS = 1 << 10
#: A block is unfolded into a matrix where it has at most so many features, and so many for each cell a row has on average.
WIDE, SPARSE = 1 << 13, 64


def known_features(rows: DataFrame, texts: dict[str, Column], categories: list[str], k: int, min_df: int) -> DataFrame:
    """(block, feature, n0..): in how many rows of each fold a gram or category is; grams in fewer than min_df rows are none."""
    parts = [rows.select(F.lit(b).alias("block"), "fold", F.explode(F.array_distinct(g)).alias("feature"), F.lit(min_df).alias("_least")) for b, g in texts.items()]
    each = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in categories]) if categories else F.array().cast("array<string>")
    parts.append(rows.select(F.lit("meta").alias("block"), "fold", F.explode(each).alias("feature"), F.lit(1).alias("_least")))
    found = reduce(DataFrame.unionByName, parts).where("feature IS NOT NULL").groupBy("block", "feature")
    return found.agg(*[F.expr(f"count_if(fold = {f})").alias(f"n{f}") for f in range(k)], F.count("*").alias("_n"), F.first("_least").alias("_least")).where("_n >= _least").drop("_n", "_least")


def ridge_by_scans(rows: DataFrame, key: str, y: str, texts: dict[str, Column], numbers: list[str], categories: list[str], variants: dict[str, list[str]], k: int = 5, min_df: int = 2, alphas: tuple[float, ...] = ALPHAS, tol: float = 1e-6, most: int = 100) -> DataFrame | None:
    """`ridge_over_folds` on the cells of the texts, categories ("meta") and numbers ("surface"), a scan a pass; None where the features are too many for it.

    The same recurrence, with its vectors in features: a vector over rows is r = X s + c (y - its
    mean) inside the folds, centred, and X X' r needs X' r alone. Rows are packed once, a row an item: places and
    counts of its grams. A scan unfolds some rows' weights, adds r'r and X' r up in its task, and a
    number a feature, variant and setting reaches the driver, whatever the rows are. Blocks of few
    features are multiplied as matrices, others cell by cell.
    """
    spark, settings, names = rows.sparkSession, held_out(k), sorted(variants)
    known, _ = written(known_features(rows, texts, categories, k, min_df), "features")
    blocks = [b for b in [*texts, "meta", "surface"] if any(b in variants[v] for v in names)]
    using = {b: [i for i, v in enumerate(names) if b in variants[v]] for b in blocks}
    sizes = {r["block"]: r["count"] for r in known.groupBy("block").count().collect()} | {"surface": len(numbers)}
    if sum(sizes.get(b, 0) * len(using[b]) for b in blocks) * len(settings) * (most + 3 * len(alphas)) > MOST_NUMBERS:
        return None
    table = known.where(F.col("block").isin(blocks)).orderBy("block", "feature").toPandas()
    inside = np.array([[h not in s for h in range(k)] for s in settings.values()])  # setting, fold
    folds = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(y).alias("s")).collect()}
    n_of = inside @ np.array([folds[h]["n"] if h in folds else 0 for h in range(k)], float)
    if not folds:
        return with_penalties(spark.createDataFrame([], rows.select(F.lit("").alias("variant"), key, "fold", y, F.lit(0).alias("_a"), *[F.lit(0.0).alias(f"_p{f}") for f in range(k)]).schema), names, key, y, k, alphas, np.zeros((len(names), len(settings), len(alphas))))
    with np.errstate(invalid="ignore", divide="ignore"):
        y_mean = inside @ np.array([folds[h]["s"] if h in folds else 0.0 for h in range(k)], float) / n_of

    places, scales, full = {}, {}, set()  # of a block: place by feature, and the factor of a feature by setting; full: blocks that are unfolded into matrices
    for b in blocks:
        own = table[table["block"] == b]
        df = own[[f"n{f}" for f in range(k)]].to_numpy(float) @ inside.T
        places[b] = {c: i for i, c in enumerate(numbers if b == "surface" else own["feature"])}
        cells_of = len(numbers) if b == "surface" else own[[f"n{f}" for f in range(k)]].to_numpy(float).sum() / sum(h["n"] for h in folds.values())
        if len(places[b]) <= min(WIDE, SPARSE * cells_of):
            full.add(b)
        scales[b] = np.ones((len(numbers), len(settings))) if b == "surface" else (df > 0).astype(float) if b == "meta" else np.where(df >= min_df, np.log((1 + n_of) / (1 + df)) + 1, 0.0)
    width, unit, sizes = len(settings), set(texts), {b: len(places[b]) for b in blocks}
    dictionary = spark.sparkContext.broadcast((places, scales))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, scales = dictionary.value
        for batch in batches:
            out = {key: batch[key], "fold": batch["fold"], y: batch[y]}
            for b in blocks:
                if b == "surface":
                    value = np.nan_to_num(batch[[f"_s{j}" for j in range(len(numbers))]].to_numpy(float))
                    row, at = np.nonzero(value)
                    value = value[row, at]
                else:
                    row = np.repeat(np.arange(len(batch)), [0 if c is None else len(c) for c in batch[f"_{b}"]])
                    at = pd.Series([g for c in batch[f"_{b}"] if c is not None for g in c], dtype=object).map(places[b]).fillna(-1).to_numpy(np.int64)
                    cell, count = np.unique((row * max(1, len(places[b])) + at)[at >= 0], return_counts=True)
                    row, at = np.divmod(cell, max(1, len(places[b])))
                    value = 1 + np.log(count) if b in unit else np.ones(len(count))
                edges = np.searchsorted(row, np.arange(1, len(batch)))
                out[f"i_{b}"], out[f"v_{b}"] = np.split(at.astype(np.int32), edges), np.split(value, edges)
                if b in unit:  # length 1 a row and setting
                    length = np.zeros((len(batch), width))
                    for a in range(0, len(batch), ROWS):
                        some = slice(*np.searchsorted(row, (a, a + ROWS)))
                        length += np.stack([np.bincount(row[some], (value[some] * scales[b][at[some], t]) ** 2, len(batch)) for t in range(width)], axis=1)
                    out[f"l_{b}"] = list(np.divide(1.0, np.sqrt(length), out=np.zeros_like(length), where=length > 0))
            yield pd.DataFrame(out)

    own = [g.alias(f"_{b}") for b, g in texts.items() if b in blocks]
    if "meta" in blocks:
        own.append(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in categories]).cast("array<string>").alias("_meta"))
    if "surface" in blocks:
        own += [F.col(c).cast("double").alias(f"_s{j}") for j, c in enumerate(numbers)]
    kind = dict(rows.dtypes)[key]
    shape = f"`{key}` {kind}, fold int, `{y}` double, " + ", ".join(f"`i_{b}` array<int>, `v_{b}` array<double>" + (f", `l_{b}` array<double>" if b in texts else "") for b in blocks)
    packed, _ = written(rows.select(key, "fold", y, *own).mapInPandas(pack, shape), "packed")

    # a vector: a line a block, feature and variant that has the block
    starts = np.cumsum([0, *[len(places[b]) * len(using[b]) for b in blocks]])
    of = np.concatenate([np.tile(using[b], len(places[b])) for b in blocks]).astype(np.int64)
    factor = np.concatenate([np.repeat(scales[b], len(using[b]), axis=0) for b in blocks])
    by_variant = lambda m: np.stack([m[of == i].sum(axis=0) for i in range(len(names))])

    def cells(batch: pa.RecordBatch) -> list[tuple]:
        """(block's place, rows, features, values, lengths) of each block with a cell; of a full one its matrix stands for the values."""
        found = []
        for j, b in enumerate(blocks):
            at, value = batch.column(f"i_{b}"), batch.column(f"v_{b}").flatten().to_numpy()[:, None]
            row = np.repeat(np.arange(len(batch)), at.value_lengths().to_numpy(zero_copy_only=False))
            at = at.flatten().to_numpy()
            length = batch.column(f"l_{b}").flatten().to_numpy().reshape(len(batch), 1, width) if b in unit else 1.0
            if b in full and len(row):
                matrix = np.zeros((len(batch), sizes[b]))
                matrix[row, at] = value[:, 0]
                value = matrix
            if len(row):
                found.append((j, row, at, value, length))
        return found

    def product(n: int, found: list[tuple], s: np.ndarray) -> np.ndarray:
        """X s of n rows' cells, by row, variant and setting; s has the features' factors in it."""
        out = np.zeros((n, len(names), width))
        for j, row, at, value, length in found:
            own = s[starts[j] : starts[j + 1]].reshape(-1, len(using[blocks[j]]) * width)
            if blocks[j] in full:
                part = (value @ own).reshape(n, -1, width)
            else:
                edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                part = np.zeros((n, len(using[blocks[j]]), width))
                part[row[edge]] = np.add.reduceat(own[at] * value, edge).reshape(len(edge), -1, width)
            out[:, using[blocks[j]]] += part * length
        return out

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                yield batch.slice(a, ROWS)

    def scan(s: np.ndarray, c: np.ndarray, plus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(X' r, r'r) of r = X s + plus + c (y - its mean) inside the folds, 0 outside."""
        shared = spark.sparkContext.broadcast((s * factor, c, plus))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, c, plus = shared.value
            sums, squares = np.zeros((starts[-1], width)), np.zeros((len(names), width))
            for batch in sliced(batches):
                within, found = inside[:, batch.column("fold").to_numpy()].T[:, None, :], cells(batch)
                r = (product(len(batch), found, s) + plus + c * (batch.column(y).to_numpy()[:, None, None] - np.nan_to_num(y_mean))) * within
                squares += (r * r).sum(axis=0)
                for j, row, at, value, length in found:
                    part = (r[:, using[blocks[j]]] * length).reshape(len(batch), -1)
                    own = sums[starts[j] : starts[j + 1]].reshape(-1, part.shape[1])
                    if blocks[j] in full:
                        own += value.T @ part
                    else:
                        order = np.argsort(at, kind="stable")
                        edge = np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1])))
                        own[at[order][edge]] += np.add.reduceat(part[row[order]] * value[order], edge)
            some = np.concatenate((np.flatnonzero(sums.any(axis=1)), -1 - np.arange(len(names))))
            values = np.concatenate((sums[some[some >= 0]], squares))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(values[:, t].copy()) for t in range(width)]], names=["at", *[f"q{t}" for t in range(width)]])

        found = packed.mapInArrow(add, "at long, " + ", ".join(f"q{t} double" for t in range(width)))
        found = found.groupBy("at").agg(*[F.sum(f"q{t}").alias(f"q{t}") for t in range(width)]).toPandas()  # a row a feature and variant
        at, values = found["at"].to_numpy(np.int64), found.drop(columns="at").to_numpy(float)
        q, squares = np.zeros((starts[-1], width)), np.zeros((len(names), width))
        q[at[at >= 0]], squares[-1 - at[at < 0]] = values[at >= 0], values[at < 0]
        return q * factor, squares

    lanczos, none = Recurrence((len(names), width), alphas, tol, most), np.zeros((len(names), width))
    mean, _ = scan(np.zeros((starts[-1], width)), none, none + np.divide(1.0, n_of, out=np.zeros(width), where=n_of > 0))
    s, c, passes = np.zeros((starts[-1], width)), none + 1.0, []
    s_before, c_before = s, none
    while True:
        q, rr = scan(s, c, -by_variant(mean * s))
        step = lanczos.take(rr, by_variant(q * q), by_variant(mean * q))
        if step is None:
            break
        passes.append(q)
        scale, _, diagonal, off = step
        on = scale > 0
        s_now, c_now = s * scale[of], c * scale
        s = np.where(on[of], q * scale[of] - diagonal[of] * s_now - off[of] * s_before, 0.0)
        c = np.where(on, -diagonal * c_now - off * c_before, 0.0)
        s_before, c_before = s_now, c_now

    weights = lanczos.weights()
    beta = np.zeros((len(alphas), starts[-1], width))
    for q, w in zip(passes, weights):
        beta += np.moveaxis(q[:, :, None] * w[of], 2, 0)
    solved = spark.sparkContext.broadcast((beta * factor, lanczos.offset(y_mean, weights)))
    place = {t: i for i, t in enumerate(settings)}
    at = np.array([[place[f"{min(f, h)}_{max(f, h)}"] for f in range(k)] for h in range(k)])  # of a row in fold h with f held out

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, offset = solved.value
        for batch in sliced(batches):
            fold, found = batch.column("fold").to_numpy(), cells(batch)
            for a in range(len(alphas)):
                p = product(len(batch), found, beta[a]) + offset[:, :, a]
                p = np.take_along_axis(p, np.broadcast_to(at[fold][:, None, :], (len(batch), len(names), k)), axis=2)
                for i, v in enumerate(names):
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(batch)), batch.column(key), batch.column("fold"), batch.column(y), pa.array(np.full(len(batch), a, np.int32)), *[pa.array(p[:, i, f].copy()) for f in range(k)]], names=["variant", key, "fold", y, "_a", *[f"_p{f}" for f in range(k)]])

    made = packed.mapInArrow(predict, f"variant string, `{key}` {kind}, fold int, `{y}` double, _a int, " + ", ".join(f"_p{f} double" for f in range(k)))
    return with_penalties(made, names, key, y, k, alphas, lanczos.worst)


#: Inputs by variant, and the differences that are reported.
VARIANTS = {
    "stem": ["stem", "meta"],
    "stem + key": ["stem", "key", "meta"],
    "stem + key + distractors": ["stem", "key", "distractors", "meta"],
    "stem + key + surface": ["stem", "key", "surface", "meta"],
    "stem + key + distractors + surface": ["stem", "key", "distractors", "surface", "meta"],
}
DIFFERENCES = [
    ("stem + key", "stem"),
    ("stem + key + distractors", "stem + key"),
    ("stem + key + surface", "stem + key"),
    ("stem + key + distractors + surface", "stem + key"),
    ("stem + key + distractors + surface", "stem"),
]


def option_ablation(items: DataFrame, key: str, y: str, group: str, texts: dict[str, Column], numbers: list[str], categories: list[str], variants: dict[str, list[str]] = VARIANTS, k: int = 5, min_df: int = 2, tol: float = 1e-6, most: int = 100) -> DataFrame:
    """Out-of-fold predictions, with the group, of ridge on the grams of each text, categories ("meta") and numbers ("surface"). Items without y are left out; folds hold whole groups."""
    with temporary(items.sparkSession):
        rows, _ = written(group_folds(items.where(F.col(y).isNotNull()).withColumn(y, F.col(y).cast("double")), group, k), "folds")
        pred = ridge_by_scans(rows, key, y, texts, numbers, categories, variants, k, min_df, tol=tol, most=most)
        if pred is not None:
            return written(pred.join(rows.select(key, group), key), "out-of-fold", keep=True)[0]
        parts = [text_cells(rows, key, block, grams, k, min_df) for block, grams in texts.items()]
        parts += [category_cells(rows, key, "meta", categories, k), number_cells(rows, key, "surface", numbers, k)]
        cells, _ = written(reduce(DataFrame.unionByName, parts), "cells")
        pred = ridge_over_folds(rows.select(key, "fold", y), cells, key, y, variants, k, tol=tol, most=most)
        return written(pred.join(rows.select(key, group), key), "out-of-fold", keep=True)[0]


def ablation_report(pred: DataFrame, y: str, group: str, differences: list[tuple[str, str]] = DIFFERENCES, reps: int = 1000) -> DataFrame:
    """(variant, less, stat, value, ci_low, ci_high, fold_mean, fold_sd, residual): r and RMSE of each variant, and paired differences of two.

    Intervals resample groups, the same for all variants. fold_mean and fold_sd are of r by fold, residual the largest (null elsewhere).
    """
    from .metrics import bootstrap

    names = sorted({r["variant"] for r in pred.select("variant").distinct().collect()})  # a row a variant
    key = [c for c in pred.columns if c not in ("variant", "fold", y, "alpha", "yhat", "residual", group)]
    wide = pred.groupBy(*key, group).agg(F.first(y).alias("_y"), *[F.max(F.when(F.col("variant") == v, F.col("yhat"))).alias(f"_x{i}") for i, v in enumerate(names)])
    moments = {"n": F.lit(1.0), "sy": F.col("_y"), "syy": F.col("_y") ** 2}
    for i in range(len(names)):
        x = F.col(f"_x{i}")
        moments |= {f"sx{i}": x, f"sxx{i}": x * x, f"sxy{i}": x * F.col("_y")}
    r = {v: f"try_divide(n * sxy{i} - sx{i} * sy, sqrt((n * sxx{i} - sx{i} * sx{i}) * (n * syy - sy * sy)))" for i, v in enumerate(names)}
    rmse = {v: f"sqrt(greatest(sxx{i} - 2 * sxy{i} + syy, 0) / n)" for i, v in enumerate(names)}
    stats = {f"{v}||{s}": of[v] for v in names for s, of in (("r", r), ("rmse", rmse))}
    stats |= {f"{a}|{b}|{s}": f"{of[a]} - {of[b]}" for a, b in differences if a in names and b in names for s, of in (("r", r), ("rmse", rmse))}
    made = bootstrap(wide, [group], moments, stats, reps)
    parts = F.split("stat", r"\|")
    made = made.select(parts[0].alias("variant"), F.when(parts[1] != "", parts[1]).alias("less"), parts[2].alias("stat"), "value", "ci_low", "ci_high")
    folds = pred.groupBy("variant", "fold").agg(F.corr(y, "yhat").alias("_r"), F.max("residual").alias("_left")).groupBy("variant").agg(F.avg("_r").alias("fold_mean"), F.stddev_samp("_r").alias("fold_sd"), F.max("_left").alias("residual")).withColumn("stat", F.lit("r"))
    return made.join(folds, ["variant", "stat"], "left").withColumns({c: F.when(F.col("less").isNull(), F.col(c)) for c in ("fold_mean", "fold_sd", "residual")}).select("variant", "less", "stat", "value", "ci_low", "ci_high", "fold_mean", "fold_sd", "residual")
