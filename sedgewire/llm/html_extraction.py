"""Main text of web pages: gradient-boosted trees over DOM blocks, decoded down the tree.

Each block element gets a probability of belonging to the main text. Decoding is one choice over the tree: to
drop a block is to drop all in it, so a kept block never hangs under a dropped one; the best set of
subtrees is found from the leaves up. The trees learn from made-up pages (page_samples.py).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.boosting import BoostedTrees
from sedgewire.llm.common import in_batches, map_arrow, with_fields, without_columns
from sedgewire.llm.page_samples import sample_pages
from sedgewire.llm.page_tree import AT, LOOSE, TOKENS, Page, features, read_page


_MARK_END = re.compile(r" data-(?:in|out)>")
_MARK = re.compile(r"<(\w+)([^>]*) data-(in|out)>")


def _labels(source: str) -> tuple[Page, np.ndarray, np.ndarray]:
    """A made-up page with, for each block, whether it belongs to the main text, and whether that is known (not so above the main part)."""
    page = read_page(_MARK_END.sub(" hidden>", source))  # the mark is read as a flag that no made-up page has otherwise
    marks = [("x" if m[3] == "in" else "o") for m in _MARK.finditer(source)]
    tags = [m[1] for m in _MARK.finditer(source)]
    # the marks come in page order, as blocks do; every marked element is a block or starts a loose run
    state = np.zeros(len(page.blocks), np.int8)
    positions = [i for i, b in enumerate(page.blocks) if b.hidden]
    for i in positions:
        page.blocks[i].hidden = False
    for number, mark in zip(positions, marks, strict=True):
        state[number] = 1 if mark == "x" else -1
    assert all(page.blocks[k].tag in (t, LOOSE) for k, t in zip(positions, tags, strict=True))
    for i, b in enumerate(page.blocks):
        if i and not state[i]:
            state[i] = state[b.parent]
    return page, state == 1, state != 0


def token_odds(pages: list[tuple[Page, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each token the smoothed log odds that a block that carries it belongs to the main text; each page counts a token once in and once out."""
    seen = np.zeros((2, TOKENS))
    for page, inside, known in pages:
        said = {(int(inside[i]), t) for i, b in enumerate(page.blocks) if known[i] for t in b.tokens}
        for y, t in said:
            seen[y, t] += 1
    return np.log(seen[1] + 0.5) - np.log(seen[0] + 0.5)


@functools.lru_cache(maxsize=2)
def fitted(pages: int = 1200, seed: int = 3) -> BoostedTrees:
    """The model; made anew in each driver, the same each time. Tokens are learned from every third page, trees from the others, so that they meet the odds as those of unseen pages."""
    made = [_labels(source) for source in sample_pages(pages, seed, mute=0.12)]
    odds = token_odds(made[::3])
    xs, ys, ws = [], [], []
    for page, inside, known in (m for k, m in enumerate(made) if k % 3):
        xs.append(features(page, odds)[known])
        ys.append(inside[known])
        ws.append(np.full(int(known.sum()), 1 / np.sqrt(max(1, known.sum()))))
    model = BoostedTrees(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws) * 8)
    model.odds = odds
    return model


def decode(page: Page, logits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which blocks stay: the set closed under parents (the root and what merely holds other blocks come free) with the greatest sum of weighted logits."""
    n = len(page.blocks)
    worth = logits * (0.5 + np.log1p(sizes))
    worth[0] = 0
    for i, b in enumerate(page.blocks):
        if b.tag == "body" or (b.chars == 0 and len(b.children) > 0 and logits[i] > -1):
            worth[i] = max(worth[i], 0) if b.tag != "body" else 0
    total = worth.copy()
    for i in range(n - 1, 0, -1):
        if total[i] > 0:
            total[page.blocks[i].parent] += total[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.blocks[i].parent] and (total[i] > 0 or page.blocks[i].tag == "body")
    return keep


def _extract_batch(batch: pa.RecordBatch, model: BoostedTrees) -> pa.RecordBatch:
    pages = [read_page(source or "") for source in batch.column("html").to_pylist()]
    tables = [features(p, model.odds) for p in pages]
    logits = model.logits(np.concatenate(tables)) if tables else np.zeros(0)
    out, at = [], 0
    for page, table in zip(pages, tables, strict=True):
        own = logits[at : at + len(table)]
        at += len(table)
        keep = decode(page, own, np.expm1(table[:, AT["log_chars"]]))
        kept = [text for block, text in page.runs if keep[block]]
        if not kept and all(b.tag in ("html", "body", LOOSE) for b in page.blocks if b.chars):  # nothing but runs in the body, and none of them chosen
            kept = [text for _, text in page.runs]
        out.append("\n".join(kept))
    return batch.drop_columns(["html"]).append_column("main_text", pa.array(out, pa.string()))


def extract(pages: DataFrame) -> DataFrame:
    """pages without html but with main_text: the kept text runs in page order, joined by line ends; empty if there are none.

    White space in a run is one space; line breaks within a block are white space. A null page is empty. A run of text directly in the body is a block of its own, kept or
    dropped as others are; a page that has no other text and would lose all of it keeps it.
    A column named main_text is replaced.
    """
    pages = without_columns(pages, "main_text")
    shared = pages.sparkSession.sparkContext.broadcast(fitted())
    ddl = with_fields([f for f in pages.schema if f.name != "html"], "main_text string")
    return map_arrow(pages, lambda it: in_batches(lambda b: _extract_batch(b, shared.value), it, 256, 2 << 20), ddl)


def main_texts(pages: DataFrame) -> DataFrame:
    """The contract's columns, a row for each row of pages: a null page has an empty text, repeated rows repeat. Other columns are ignored."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
