"""Rectangles: overlap, containment, greedy suppression. A rectangle is struct(x, y, width, height); rectangles.py joins them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area(r: Column) -> Column:
    return r["width"] * r["height"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union has no area."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def contains(r: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a rectangle, its edges included."""
    return x.between(r["x"], r["x"] + r["width"]) & y.between(r["y"], r["y"] + r["height"])


def moved(r: Column, dx: Column, dy: Column) -> Column:
    """The rectangle relative to another origin."""
    return F.struct((r["x"] - dx).alias("x"), (r["y"] - dy).alias("y"), r["width"].alias("width"), r["height"].alias("height"))


def _iou_matrix(r: np.ndarray) -> np.ndarray:
    x, y, w, h = r.T
    right, bottom = x + w, y + h
    iw = np.clip(np.minimum(right[:, None], right) - np.maximum(x[:, None], x), 0, None)
    ih = np.clip(np.minimum(bottom[:, None], bottom) - np.maximum(y[:, None], y), 0, None)
    both = iw * ih
    union = (w * h)[:, None] + w * h - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def _per_group(df: DataFrame, group: str, keep) -> DataFrame:
    """Sequential by nature: each group (an image, a screen) is one pandas frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        r = np.array([[v["x"], v["y"], v["width"], v["height"]] for v in pdf["rect"]], float).reshape(-1, 4)
        return pdf.iloc[keep(r)]

    return df.groupBy(group).applyInPandas(run, df.schema)


def suppress(df: DataFrame, group: str, threshold: float = 0.7) -> DataFrame:
    """Greedy suppression: largest first, a rectangle stays if it overlaps no kept one by the threshold or more."""

    def keep(r: np.ndarray) -> list[int]:
        m, out = _iou_matrix(r), []
        for i in np.argsort(-(r[:, 2] * r[:, 3]), kind="stable"):
            if not out or m[i, out].max() < threshold:
                out.append(int(i))
        return out

    return _per_group(df, group, keep)


def keep_smaller(df: DataFrame, group: str) -> DataFrame:
    """Of overlapping pairs the larger goes, pairs in order; of equal ones the later. A rectangle that is gone removes no other."""

    def keep(r: np.ndarray) -> list[int]:
        m, size, gone = _iou_matrix(r), r[:, 2] * r[:, 3], set()
        for i in range(len(r)):
            for j in range(i + 1, len(r)):
                if i in gone:
                    break
                if j not in gone and m[i, j] > 0:
                    gone.add(i if size[i] > size[j] else j)
        return [i for i in range(len(r)) if i not in gone]

    return _per_group(df, group, keep)


def cluster_players(df: DataFrame, group: str) -> DataFrame:
    """Greedy clusters of records pos, title, position, length, art: `cluster` is the first member's pos, `chosen` the one to show.

    A record joins the first cluster whose opener has a title that holds its own or is held by it, or whose
    position and length are both within 2. Each record joins one cluster. The first member with a cover
    is shown, else the first.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", cluster int, chosen boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        cluster: list[int | None] = [None] * len(pdf)
        rows = list(pdf.itertuples())
        for i, a in enumerate(rows):
            if cluster[i] is not None:
                continue
            cluster[i] = int(a.pos)
            for j in range(i + 1, len(rows)):
                b = rows[j]
                titles = bool(a.title) and bool(b.title) and (a.title in b.title or b.title in a.title)
                if cluster[j] is None and (titles or (abs(a.position - b.position) <= 2 and abs(a.length - b.length) <= 2)):
                    cluster[j] = int(a.pos)
        pdf["cluster"] = cluster
        shown = {}
        for c, pos, art in zip(cluster, pdf["pos"], pdf["art"]):
            if c not in shown or (art and not shown[c][1]):
                shown[c] = (pos, bool(art))
        pdf["chosen"] = [shown[c][0] == pos for c, pos in zip(cluster, pdf["pos"])]
        return pdf

    return df.groupBy(group).applyInPandas(run, schema)
