"""Main text of web pages: a linear-chain CRF over DOM leaf blocks."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, table
from .dom import Block, blocks
from .labelled_pages import labelled_pages

#: Labelled pages to train on, and steps of the fit.
PAGES = 600
STEPS = 120
PENALTY = 0.02
SEED = 11


def _shape(b: Block) -> tuple[int, int]:
    """(size, share of linked text) of a block, in steps."""
    n = len(b.text)
    link = b.linked / n
    return 0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3 if n < 300 else 4, 0 if link < 0.1 else 1 if link < 0.5 else 2


def _features(page: list[Block]) -> list[list[str]]:
    """What the model sees of each block: ancestors, names, and the shapes of its text and its neighbours."""
    out = []
    total = max(1, len(page))
    shapes = [_shape(b) for b in page]
    for i, b in enumerate(page):
        size, link = shapes[i]
        f = b.features
        before, after = (shapes[j] if 0 <= j < len(page) else (9, 9) for j in (i - 1, i + 1))
        near = [s for s, k in shapes[max(0, i - 2) : i + 3] if not k]
        stop = b.text[-1] in ".!?…"
        out.append(
            [
                *f,
                "any",
                f"size:{size}",
                f"link:{link}",
                f"stop:{stop}",
                f"rights:{'©' in b.text}",
                f"place:{4 * i // total}",
                f"{f[0]},size:{size}",
                f"size:{size},stop:{stop}",
                f"before:{before[0]},{before[1]}",
                f"after:{after[0]},{after[1]}",
                f"near:{max(near, default=9)},{size}",
                f"long:{sum(s >= 3 for s in near)}",
            ]
        )
    return out


class Chain:
    """Labels 0 (other) and 1 (main text) of the blocks of a page, in order.

    The score of a labelling is the sum of a weight for each feature and label, and
    of one for each pair of successive labels. Weights maximise the likelihood of
    labelled pages, with a quadratic penalty; decoding is by Viterbi.
    """

    def __init__(self, weights: dict[str, tuple[float, float]], moves, start):
        self.weights, self.moves, self.start = weights, moves, start

    def decode(self, page: list[Block]) -> list[int]:
        if not page:
            return []
        get, none, back = self.weights.get, (0.0, 0.0), []
        (m00, m01), (m10, m11) = self.moves
        a = b = None
        for fs in _features(page):
            x = y = 0.0
            for f in fs:
                u, v = get(f, none)
                x += u
                y += v
            if a is None:
                a, b = self.start[0] + x, self.start[1] + y
                continue
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[Block], list[int]]]) -> Chain:
        number: dict[str, int] = {}
        rows = [[[number.setdefault(f, len(number)) for f in fs] for fs in _features(p)] for p, _ in pages]
        n, t = len(pages), max(len(p) for p, _ in pages)
        k = max(len(fs) for p in rows for fs in p)
        pad = len(number)
        x = np.full((n, t, k), pad)
        y = np.zeros((n, t), dtype=int)
        real = np.zeros((n, t), dtype=bool)
        for i, (p, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
            for j, fs in enumerate(p):
                x[i, j, : len(fs)] = fs
            y[i, : len(labels)] = labels
            real[i, : len(labels)] = True
        w, moves, start = np.zeros((pad + 1, 2)), np.zeros((2, 2)), np.zeros(2)
        gold = np.eye(2)[y] * real[..., None]
        pairs = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum((0, 1))
        moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, moves, start)]
        for step in range(1, STEPS + 1):
            e = w[x].sum(2)
            a, z = np.empty((n, t, 2)), np.zeros((n, t, 2))
            a[:, 0] = e[:, 0] + start
            for j in range(1, t):
                v = np.logaddexp.reduce(a[:, j - 1, :, None] + moves, axis=1) + e[:, j]
                a[:, j] = np.where(real[:, j, None], v, a[:, j - 1])
            for j in range(t - 2, -1, -1):
                v = np.logaddexp.reduce(moves + (e[:, j + 1] + z[:, j + 1])[:, None, :], axis=2)
                z[:, j] = np.where(real[:, j + 1, None], v, 0.0)
            total = np.logaddexp.reduce(a[:, -1], axis=1)
            marginal = np.exp(a + z - total[:, None, None]) * real[..., None]
            both = a[:, :-1, :, None] + moves + (e + z)[:, 1:, None, :] - total[:, None, None, None]
            expected = (np.exp(np.minimum(both, 0.0)) * real[:, 1:, None, None]).sum((0, 1))
            off = gold - marginal
            gw = np.zeros_like(w)
            for label in (0, 1):
                gw[:, label] = np.bincount(
                    x.ravel(), weights=np.repeat(off[..., label].ravel(), k), minlength=pad + 1
                )
            grads = (gw - PENALTY * n * w, pairs - expected - PENALTY * n * moves, off[:, 0].sum(0))
            for v, g, m in zip((w, moves, start), grads, moments, strict=True):  # Adam
                g = g / n
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                v += 0.2 * (1 - step / (STEPS + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
            w[pad] = 0.0
        weights = {f: (float(w[i, 0]), float(w[i, 1])) for f, i in number.items()}
        return cls(weights, moves.tolist(), start.tolist())


_NAMED = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""")
_PARTS = re.compile(r"(</?)(?:article|main|section|nav|aside|header|footer)\b")


def _unnamed(html: str, how: int) -> str:
    """The page without names of its parts; with ``how`` 2 all parts are plain ones."""
    html = _NAMED.sub("", html)
    return _PARTS.sub(r"\1div", html) if how == 2 else html


@lru_cache(2)
def trained(pages: int = PAGES, seed: int = SEED) -> Chain:
    """The model, fitted to ``pages`` labelled pages: the bound of what it learns from.

    A tenth of them have lost the names of their parts, and another tenth also the
    elements that tell what a part is, so that the model learns to do without.
    """
    found = []
    for k, (html, main) in enumerate(labelled_pages(pages, seed)):
        page = blocks(_unnamed(html, k % 10 - 7) if k % 10 > 7 else html)
        if page:
            found.append((page, [int(b.text in main) for b in page]))
    return Chain.fit(found)


def _extractor(model):
    def run(batches):
        chain = model.value
        for b in batches:
            texts = []
            for html in b.column(b.num_columns - 1).to_pylist():
                page = blocks(html)
                labels = chain.decode(page)
                texts.append("\n".join(x.text for x, y in zip(page, labels, strict=True) if y))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=[*b.schema.names[:-1], "text", "n_chars"],
            )

    return run


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    model: Chain | None = None,
) -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars: the main text of each whole page.

    Pages are cut into leaf blocks; a conditional random field, trained on labelled
    pages of many layouts, decodes which blocks are the article; these are joined by
    line ends in page order. One row for each row, without a shuffle.

    Null or empty html, and pages without an article: empty text. Null ids, null urls
    and repeated rows pass through. An empty table gives an empty result.
    """
    rows = pages.select(id_col, url_col, html_col)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2]]
    fitted = pages.sparkSession.sparkContext.broadcast(model or trained())
    return rows.transform(arrow, _extractor(fitted), ", ".join([*kinds, "text string", "n_chars long"]))


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
