"""Grey and colour pixel tables: statistics, integral images, quiet regions, clusters.

Pixels are rows (img, y, x, val) or (img, r, g, b); a whole image as one array is one row of `pixels`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def colourfulness(pixels: DataFrame, key: str = "img") -> DataFrame:
    """key, colourfulness: spread plus three tenths of the mean of the opponent axes, with population deviations."""
    rg, yb = F.col("r") - F.col("g"), (F.col("r") + F.col("g")) / 2 - F.col("b")
    spread = F.sqrt(F.pow(F.stddev_pop(rg), 2) + F.pow(F.stddev_pop(yb), 2))
    return pixels.groupBy(key).agg((spread + 0.3 * F.sqrt(F.pow(F.avg(rg), 2) + F.pow(F.avg(yb), 2))).alias("colourfulness"))


def scheme(c: Column) -> Column:
    """A colour scheme's name by colourfulness."""
    return F.when(c < 20, "scheme-content").when(c < 50, "scheme-neutral").otherwise("scheme-tonal-spot")


def integral(pixels: DataFrame) -> DataFrame:
    """img, y, x, s, q: sums of val and of its square over all pixels up to (y, x)."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    part = pixels.withColumns({"_s": F.sum("val").over(row), "_q": F.sum(F.col("val") * F.col("val")).over(row)})
    return part.select("img", "y", "x", F.sum("_s").over(column).alias("s"), F.sum("_q").over(column).alias("q"))


def window_variance(pixels: DataFrame, width: int, height: int, stride: int = 1) -> DataFrame:
    """img, y, x, variance of each rectangle with its top left at (y, x), from four corners of the integral image."""
    total = integral(pixels)
    corner = lambda dy, dx, sign: total.select("img", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), (sign * F.col("s")).alias("s"), (sign * F.col("q")).alias("q"), F.lit(1 if sign > 0 and dy == height - 1 and dx == width - 1 else 0).alias("end"))
    parts = corner(height - 1, width - 1, 1).unionByName(corner(-1, width - 1, -1)).unionByName(corner(height - 1, -1, -1)).unionByName(corner(-1, -1, 1))
    out = parts.groupBy("img", "y", "x").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("end").alias("end"))
    n = width * height
    return out.where(f"end = 1 and y >= 0 and x >= 0 and y % {stride} = 0 and x % {stride} = 0").select("img", "y", "x", (F.col("q") / n - F.pow(F.col("s") / n, 2)).alias("variance"))


def quietest(pixels: DataFrame, width: int, height: int, stride: int = 1) -> DataFrame:
    """The rectangle of least variance of each image, the first of equal ones."""
    w = Window.partitionBy("img").orderBy(F.round("variance", 9), "y", "x")
    return window_variance(pixels, width, height, stride).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equal ones."""
    n = df.groupBy(*keys, value).count()
    return n.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), value))).where("_n = 1").drop("_n")


def _sums(v: np.ndarray) -> np.ndarray:
    return np.pad(v.astype(float), ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def _quiet_spot(s: np.ndarray, q: np.ndarray, w: int, h: int, stride: int) -> tuple[float, int, int]:
    take = lambda a: a[h:, w:] - a[:-h, w:] - a[h:, :-w] + a[:-h, :-w]
    n = w * h
    var = (take(q) / n - (take(s) / n) ** 2)[::stride, ::stride]
    at = int(np.argmin(np.round(var, 9)))
    y, x = divmod(at, var.shape[1])
    return float(var[y, x]), x * stride, y * stride


def largest_quiet(images: DataFrame, threshold: float, ratio: float = 1.0, stride: int = 1, smallest: int = 2) -> DataFrame:
    """img, x, y, width, height, variance: the largest rectangle of a side ratio whose variance is under the threshold.

    A binary search over its size, one image (img, height, width, pixels) at a time; images without one have nulls.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for img, height, width, values in zip(pdf["img"], pdf["height"], pdf["width"], pdf["pixels"]):
                v = np.asarray(values, float).reshape(height, width)
                s, q = _sums(v), _sums(v * v)
                low, high, best = smallest, int(min(width, height * ratio)), None
                while low <= high:
                    w = (low + high) // 2
                    h = max(1, round(w / ratio))
                    found = _quiet_spot(s, q, w, h, stride) if w <= width and h <= height else None
                    if found and found[0] <= threshold:
                        best, low = (found[1], found[2], w, h, found[0]), w + 1
                    else:
                        high = w - 1
                out.append((img, *(best or (None,) * 5)))
            frame = pd.DataFrame(out, columns=["img", "x", "y", "width", "height", "variance"])
            yield frame.astype({k: "Int64" for k in ("x", "y", "width", "height")})

    return images.select("img", "height", "width", "pixels").mapInPandas(run, f"img {dict(images.dtypes)['img']}, x long, y long, width long, height long, variance double")


def clusters(pixels: DataFrame, k: int = 3, rounds: int = 10, seed: int = 1) -> DataFrame:
    """pixels with `cluster` by k-means over r, g, b."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["r", "g", "b"], outputCol="_v").transform(pixels)
    return KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")


def dominant(pixels: DataFrame, k: int = 3) -> DataFrame:
    """Mean colour of the most frequent cluster."""
    c = clusters(pixels, k)
    top = most_frequent(c.withColumn("_all", F.lit(0)), ["_all"], "cluster").select("cluster")
    return c.join(F.broadcast(top), "cluster").agg(*[F.avg(x).alias(x) for x in "rgb"])  # one row


def greys(files: DataFrame) -> DataFrame:
    """img, height, width, pixels of binary PGM files (path, content) as Spark's binaryFile source reads them; other files have nulls."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                head = bytes(raw).split(None, 4) if bytes(raw[:2]) == b"P5" else []
                if len(head) == 5:
                    w, h = int(head[1]), int(head[2])
                    values = np.frombuffer(bytes(raw)[-w * h :], np.uint8).astype(int).tolist()
                    out.append((path, h, w, values))
                else:
                    out.append((path, None, None, None))
            yield pd.DataFrame(out, columns=["img", "height", "width", "pixels"]).astype({"height": "Int64", "width": "Int64"})

    return files.select("path", "content").mapInPandas(run, "img string, height long, width long, pixels array<int>")


def inverted(pixels: DataFrame) -> DataFrame:
    """pixels with the complement of each channel r, g, b (0 to 255)."""
    return pixels.withColumns({c: 255 - F.col(c) for c in "rgb"})


def scaled(pixels: DataFrame, red: float, green: float, blue: float) -> DataFrame:
    """pixels with each channel times its factor, within 0 to 255."""
    return pixels.withColumns({c: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(c) * k)) for c, k in zip("rgb", (red, green, blue))})


def palette(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cell, n, r, g, b, score: at most 128 colours of each image, the means of cells of 2 bits of red, 3 of green and 2 of blue.

    score: seven tenths for the share of the pixels, three tenths for how far the mean is from grey.
    """
    r, g, b = (F.col(c).cast("int") for c in "rgb")
    cell = F.shiftright(r, 6) * 32 + F.shiftright(g, 5) * 4 + F.shiftright(b, 6)
    means = pixels.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))  # at most 128 rows
    chroma = (F.greatest("r", "g", "b") - F.least("r", "g", "b")) / 255
    return means.withColumn("score", 0.7 * share + 0.3 * chroma)
