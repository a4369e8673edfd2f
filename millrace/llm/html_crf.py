"""Main text of web pages by a linear-chain conditional random field.

A page is a chain of leaf blocks. Features of a block are the tags above it, what their
class names hint at, and its text: length, links, punctuation. Two labels, content and
furniture, are scored by the block's features and by the label before; weights are
fitted on labelled pages by the gradient of the exact likelihood, and Viterbi finds the
best labels of a page. The field is small; it is fitted on the driver once and sent to
the tasks.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.html_blocks import INLINE, Block, blocks
from millrace.llm.html_samples import labelled_pages

# Labelled pages that the field is fitted on, unless others are given.
PAGES = 500
_HINTS = {
    "menu": r"\b(nav|menu|navbar|navigation|breadcrumbs?|topnav|toc)\b|nav(bar|igation)",
    "header": r"\b(header|masthead|banner|topbar|branding)\b",
    "footer": r"footer|\b(bottom|copyright|colophon|contentinfo|legal)\b",
    "side": r"side-?bar|\b(aside|widgets?|rail|complementary|related|recommend(ed|ations)?|popular|trending|more)\b",
    "advert": r"\b(ads?|advert\w*|sponsor\w*|promo\w*|adsense|outbrain|taboola)\b",
    "notice": r"\b(cookies?|consent|notices?|alerts?|gdpr|popup|modal|overlay|dialog|warning|disclaimer|toast)\b",
    "comment": r"comments?|\b(disqus|repl(y|ies)|respond|discussion|responses?|reviews?)\b",
    "share": r"\b(share|sharing|social|follow|tags?|byline|meta|author|pagination|pager|date)\b",
    "form": r"\b(form|search|login|subscribe|newsletter|signup|register)\b",
    "content": r"\b(content|article|articlebody|post|entry|main|body|story|text)\b",
    "hidden": r"\bhidden\b",
}
_HINTS = {name: re.compile(pattern) for name, pattern in _HINTS.items()}
_BAD = frozenset(_HINTS) - {"content"}
_BAD_TAGS = frozenset("nav header footer aside form button label fieldset dialog".split())


@lru_cache(maxsize=10_000)
def _context(tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, ...]:
    """Features of the tags above a block; pages of a site share them."""
    structure = [t for t in tags if t not in INLINE]
    hints = set()
    for name in names:
        spaced = re.sub(r"[-_/:.]", " ", name)
        hints |= {h for h, pattern in _HINTS.items() if pattern.search(spaced)}
    above = set(structure)
    # A header inside an article holds its title; one outside heads the page.
    inside = bool(above & {"article", "main"}) or "content" in hints
    bad = {f"hint {h}" for h in hints & _BAD} | {f"tag {t}" for t in above & _BAD_TAGS}
    if inside and structure and structure[-1] in ("h1", "h2"):
        bad.discard("tag header")
    out = [f"above {t}" for t in above - _BAD_TAGS] + sorted(bad)
    out += [f"leaf {structure[-1] if structure else ''}", f"inside {inside}", f"furniture {bool(bad)}",
            f"inside {inside} furniture {bool(bad)}"]
    return tuple(out)


def features(block: Block) -> list[str]:
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    link = block.linked / size
    return [
        *_context(block.tags, block.names), "every",
        f"words {min(words.bit_length(), 7)}", f"linked {0 if link < 0.1 else 1 if link < 0.6 else 2}",
        f"ends {text[-1] in '.!?:;…'}", f"sign {'©' in text[:40]}",
        f"stops {min(text.count('. ') + text.count(', '), 4)}",
    ]


class Field:
    """Weights of features (by label) and of label pairs; label 1 is content."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.state = np.zeros((len(names), 2))
        self.step = np.zeros((2, 2))

    def scores(self, page: list[Block]) -> np.ndarray:
        """Scores of both labels for each block; unknown features say nothing."""
        out = np.zeros((len(page), 2))
        for i, block in enumerate(page):
            at = [self.names[f] for f in features(block) if f in self.names]
            out[i] = self.state[at].sum(0)
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The best labels by Viterbi; content wins ties."""
        if not page:
            return []
        scores = self.scores(page).tolist()
        (aa, ab), (ba, bb) = self.step.tolist()
        no, yes = scores[0]
        back = []
        for out, content in scores[1:]:
            to_no = (0, no + aa) if no + aa > yes + ba else (1, yes + ba)
            to_yes = (0, no + ab) if no + ab > yes + bb else (1, yes + bb)
            back.append((to_no[0], to_yes[0]))
            no, yes = to_no[1] + out, to_yes[1] + content
        labels = [int(yes >= no)]
        for before in reversed(back):
            labels.append(before[labels[-1]])
        return labels[::-1]


def _log_sum(a, axis):
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages, rounds: int = 150, decay: float = 2e-3) -> Field:
    """A field for labelled pages ``(html, labels of its blocks)``."""
    chains = []
    for markup, labels in pages:
        page = blocks(markup)
        if len(page) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(page)} blocks")
        if page:
            chains.append(([features(b) for b in page], labels))
    names: dict[str, int] = {}
    for chain, _ in chains:
        for made in chain:
            for f in made:
                names.setdefault(f, len(names))
    field = Field(names)
    if not chains:
        return field
    n, longest = len(chains), max(len(c) for c, _ in chains)
    x = np.zeros((n, longest, len(names)), np.float32)
    y = np.zeros((n, longest), int)
    real = np.zeros((n, longest), bool)
    for i, (chain, labels) in enumerate(chains):
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
        for t, made in enumerate(chain):
            x[i, t, [names[f] for f in made]] = 1
    flat, pair = x[real], real[:, 1:]
    truth = np.eye(2)[y]
    seen_pairs = np.einsum("nta,ntb->ab", truth[:, :-1] * pair[..., None], truth[:, 1:])
    moments = [np.zeros((len(names), 2)), np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        score = np.zeros((n, longest, 2))
        score[real] = flat @ field.state
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            moved = _log_sum(ahead[:, t - 1, :, None] + field.step, 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], moved, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = _log_sum(field.step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], moved, 0)
        whole = _log_sum(ahead[:, -1], 1)
        share = np.exp(ahead + behind - whole[:, None, None])
        pairs = np.exp(ahead[:, :-1, :, None] + field.step + (score[:, 1:] + behind[:, 1:])[:, :, None, :]
                       - whole[:, None, None, None]) * pair[..., None, None]
        slopes = (flat.T @ (share[real] - truth[real]) / n + decay * field.state,
                  (pairs.sum((0, 1)) - seen_pairs) / n + decay * field.step)
        for i, (weights, slope) in enumerate(zip((field.state, field.step), slopes)):
            first, second = moments[2 * i], moments[2 * i + 1]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return field


def main_text(field: Field, page: str | None) -> str:
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, field.decode(found)) if label)


def extract(pages: DataFrame, *, html_column: str = "html", text_column: str = "text",
            field: Field | None = None) -> DataFrame:
    """``pages`` without the HTML, with the main ``text``: content blocks in page order,
    joined by a space; empty where there is none, as for null or empty pages.

    An input column of the text's name is replaced; other columns stay. Repeated rows
    give repeated results; no rows give none. ``field`` is one fitted on other pages.
    """
    field = field or fit(labelled_pages(PAGES))
    kept = [c for c in pages.columns if c not in (html_column, text_column)]
    markup = F.col(html_column).cast("string").alias(html_column)
    source = pages.select(*kept, markup)
    schema = pages.select(*kept, F.lit("").alias(text_column)).schema

    def run(batches):
        for batch in batches:
            made = [main_text(field, p.as_py()) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(made, pa.string())], names=[*kept, text_column])

    return source.mapInArrow(run, schema)
