"""Lines of text from the placed pieces of a PDF's pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import ship

#: Pieces whose heights differ by at most so much are on one line.
TOLERANCE = 2.0
#: A gutter is looked for in the middle third, in steps; only on pages with so many pieces.
STEP, LEAST_PIECES = 2.0, 40
#: At most this share of the pieces may cross a gutter, and at least that share must lie on each side.
MOST_ACROSS, LEAST_BESIDE = 0.02, 0.25


def gutter(left: np.ndarray, right: np.ndarray) -> float | None:
    """Where two columns part on a page, from the sides of its pieces; None if it has one.

    Of the places in steps through the middle third, the first that fewest pieces cross. Their number changes only where
    a piece begins or ends, so only the first step behind each of these is looked at, however wide the page.
    """
    n = len(left)
    if n < LEAST_PIECES:
        return None
    low, span = left.min(), right.max() - left.min()
    if not span > 0:
        return None
    first = low + span * 0.33
    steps = np.concatenate(([0], np.floor((left - first) / STEP) + 1, np.ceil((right - first) / STEP)))
    at = first + STEP * np.unique(steps[(steps >= 0) & (steps <= np.floor(span * 0.33 / STEP))])
    across = np.searchsorted(np.sort(left), at, "left") - np.searchsorted(np.sort(right), at, "right")
    best = float(at[across.argmin()])
    if across.min() > n * MOST_ACROSS:
        return None
    beside = min((right <= best).sum(), (left >= best).sum())
    return best if beside >= n * LEAST_BESIDE else None


def page_lines(page: pd.DataFrame) -> pd.DataFrame:
    """The lines of one page, (column, y, x, text, size, multi_font): in each column from the top, in each line from the left.

    A piece joins the first line that is near enough, so the order of the pieces counts. Lines are looked up by their
    height: those of a column are further apart than TOLERANCE, so few share a cell.
    """
    page = page.sort_values("position")
    page = page[page["text"].fillna("") != ""]
    inked = page[page["text"].str.strip() != ""]
    split = gutter(inked["x"].to_numpy(float), (inked["x"] + inked["width"].fillna(0)).to_numpy(float))
    rows = []
    for column in (0, 1):
        lines: list[tuple[float, list]] = []
        at_height: dict[int, list[int]] = {}
        for piece in page.itertuples():
            if (split is not None and piece.x >= split) != (column == 1):
                continue
            cell = int(piece.y // TOLERANCE)
            near = [n for c in (cell - 1, cell, cell + 1) for n in at_height.get(c, ()) if abs(lines[n][0] - piece.y) <= TOLERANCE]
            if not near:
                near = [len(lines)]
                at_height.setdefault(cell, []).append(len(lines))
                lines.append((piece.y, []))
            lines[min(near)][1].append(piece)
        for y, found in sorted(lines, key=lambda v: -v[0]):
            found.sort(key=lambda p: p.x)
            text = "".join(p.text for p in found)
            if text.strip():
                rows.append((column, y, found[0].x, text, found[0].size, len({p.font for p in found}) > 1))
    return pd.DataFrame(rows, columns=["column", "y", "x", "text", "size", "multi_font"])


def lines(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, column, y, x, text, size, multi_font) of pieces(keys, position, x, y, width, size, text[, font]).

    keys name a page, whose pieces are few, so a group is small whatever the input's size. multi_font: a line's pieces
    are in more than one font; without a font they are in one.
    """
    ship(pieces.sparkSession)
    kinds = ", ".join(f"`{k}` {pieces.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        out = page_lines(page)
        for i, (name, value) in enumerate(zip(keys, key)):
            out.insert(i, name, value)
        out.insert(len(keys), "line", range(len(out)))
        return out

    pieces = pieces if "font" in pieces.columns else pieces.withColumn("font", F.lit(""))
    made = "line int, column int, y double, x double, text string, size double, multi_font boolean"
    return pieces.groupBy(*keys).applyInPandas(run, f"{kinds}, {made}")


def page_text(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the pieces of each page in their order, parted by blanks."""
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return pieces.groupBy(*keys).agg(parts.alias("parts")).select(*keys, F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def body_size(sampled: DataFrame, key: str) -> DataFrame:
    """(key, size): the size in which most characters of a book are set; the larger of equals."""
    counts = sampled.groupBy(key, "size").agg(F.sum(F.length("text")).alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", "size"))["size"].alias("size"))


def is_heading(size: Column, bold: Column, usual: Column) -> Column:
    """Lines in bold, or in a larger size than the text's."""
    return bold | (size > usual)
