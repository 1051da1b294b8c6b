"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element and text leaf gets features: its tag, words of its
attributes and of its ancestors', depth, text and link density of its subtree,
punctuation, place among its siblings and their statistics. Boosted trees give
the probability that a node is all article, all else, or mixed. A dynamic
programme over the tree then picks the best labelling in which the descendants
of an article node are article, those of a rest node are rest, and a leaf is
never mixed; so ancestors and descendants can't contradict each other.

The trees are fitted on TRAINING_PAGES pages that `pagemaker` makes by rule:
no page of the input is a training page.

A null or empty page, or one without article text, gives an empty text.
Repeated rows get equal texts. Other columns than the key and url are not
carried. An empty table gives an empty result. Whole pages are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm import pagemaker
from tidewright.llm.boosting import Boosted, fit
from tidewright.llm.dom import LEAF, Dom, parse

TRAINING_PAGES = 420
ARTICLE, REST, MIXED = 0, 1, 2
#: Evidence that a split of a node's parts needs beyond its own, in nats.
MIXED_COST = 0.5
# Elements whose siblings of the same kind belong together.
ALIKE = set("p li h2 h3 h4 h5 h6 dt dd td th tr blockquote".split())
_GROUPS = [k for k in pagemaker.NAMES if k != "none"]
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_word_group = {w: i for i, k in enumerate(_GROUPS) for n in pagemaker.NAMES[k] for w in [n.replace("-", "")]}
_word_group |= {w: i for i, k in enumerate(_GROUPS) for n in pagemaker.NAMES[k] for w in n.split("-") if w not in ("main", "page", "top", "site", "post", "list", "box", "text", "right", "left", "see", "more", "author", "user", "reader", "top", "most", "read", "in", "up", "sign", "slot")}
_word_group |= {"hidden": _GROUPS.index("notice"), "complementary": _GROUPS.index("aside"), "contentinfo": _GROUPS.index("footer"), "articlebody": _GROUPS.index("main"), "promoted": _GROUPS.index("ad")}
# Groups of tags.
TAG_GROUPS = ["article main", "nav menu", "aside", "header hgroup", "footer", "form fieldset label legend", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tfoot tr td th", "blockquote pre figure figcaption", "div section center details", LEAF]
_tag_group = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_TAG_OF_GROUP = {"nav": "nav", "aside": "aside", "header": "header", "footer": "footer", "form": "form"}
_cache: dict[str, int] = {}


def attribute_groups(words: str) -> int:
    """Bits of the groups of names in the attributes."""
    if words not in _cache:
        bits = 0
        for token in words.split():
            parts = [p.lower() for p in _WORD.findall(token)]
            for p in [*parts, "".join(parts), *["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]]:
                p = p if p in _word_group else p.rstrip("s")
                if p in _word_group:
                    bits |= 1 << _word_group[p]
        if len(_cache) > 50_000:
            _cache.clear()
        _cache[words] = bits
    return _cache[words]


N_FEATURES = 3 * len(_GROUPS) + len(TAG_GROUPS) * 2 + 22


def features(dom: Dom) -> np.ndarray:
    """One row a node."""
    n = len(dom.tag)
    parent = np.array(dom.parent)
    group = np.array([_tag_group.get(t, 13) for t in dom.tag])
    attrs = np.array([attribute_groups(a) if a else 0 for a in dom.attributes])
    chars = np.array([len(t) for t in dom.text], float)
    linked = np.array(dom.linked, float)
    marks = np.array(dom.marks, float) + 1
    stops = np.array([t.count(".") + t.count("!") + t.count("?") for t in dom.text], float)
    commas = np.array([t.count(",") for t in dom.text], float)
    leaf = np.array([t == LEAF for t in dom.tag], float)
    rows = np.stack([chars, linked, marks, stops, commas, leaf, np.isin(group, (6, 8, 10)) * 1.0], 1)
    depth, above, above_tags = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    index, siblings, same = np.zeros(n), np.zeros(n), np.zeros(n)
    seen: dict[int, int] = {}
    tags: dict[tuple[int, int], int] = {}
    place = []
    par, att, grp = dom.parent, attrs.tolist(), group.tolist()
    dep, abv, abt = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = par[i]
        dep[i] = dep[p] + 1
        abv[i] = abv[p] | att[p]
        abt[i] = abt[p] | 1 << grp[p]
        k = seen.get(p, 0)
        index[i] = k
        seen[p] = k + 1
        tags[p, grp[i]] = tags.get((p, grp[i]), 0) + 1
    depth, above, above_tags = np.array(dep, float), np.array(abv), np.array(abt)
    for i in range(1, n):
        siblings[i] = seen[par[i]]
        same[i] = tags[par[i], grp[i]]
    total = rows.copy()
    totals = total.tolist()
    for i in range(n - 1, 0, -1):
        a, b = totals[par[i]], totals[i]
        for k in range(7):
            a[k] += b[k]
    total = np.array(totals)
    size, page = total[:, 0], max(total[0, 0], 1.0)
    starts = np.cumsum(chars) - chars
    up = np.maximum(parent, 0)
    mean_sibling = (size[up] - size) / np.maximum(siblings - 1, 1)
    before = np.append(0, size[:-1]) * (np.append(-1, parent[:-1]) == parent)
    bits = np.arange(len(_GROUPS))
    flags = [((attrs[:, None] >> bits) & 1), ((above[:, None] >> bits) & 1), ((np.where(parent >= 0, attrs[up], 0)[:, None] >> bits) & 1)]
    kinds = np.eye(len(TAG_GROUPS))[group]
    kinds_above = (above_tags[:, None] >> np.arange(len(TAG_GROUPS))) & 1
    log = np.log1p
    more = [
        depth, log(size), size / page, total[:, 1] / np.maximum(size, 1), log(total[:, 2]), size / total[:, 2], total[:, 3] / np.maximum(size, 1) * 100,
        total[:, 4] / np.maximum(size, 1) * 100, total[:, 5], size / np.maximum(total[:, 5], 1), total[:, 6] / np.maximum(total[:, 5], 1), index, siblings,
        index / np.maximum(siblings - 1, 1), same / np.maximum(siblings, 1), log(mean_sibling), log(before), starts / page, (starts + size) / page,
        size / np.maximum(size[up], 1), total[up, 1] / np.maximum(size[up], 1), group[up] * 1.0,
    ]
    return np.concatenate([*flags, kinds, kinds_above, np.stack(more, 1)], 1).astype(np.float32)


def decode(dom: Dom, logp: np.ndarray) -> list[bool]:
    """For each node whether it is article, by the best consistent labelling."""
    n, parent = len(dom.tag), dom.parent
    lp = logp.tolist()
    children = [0] * n
    for p in parent[1:]:
        children[p] += 1
    for i in range(1, n):
        if children[parent[i]] == 1:  # a block and its only child say much the same
            lp[i] = [x * 0.5 for x in lp[i]]
    # sibling paragraphs, items and headings of one kind are judged together, by their length
    groups: dict[tuple, list[int]] = {}
    for i in range(1, n):
        j = parent[i] if dom.tag[i] == LEAF and children[parent[i]] == 1 else i
        if dom.tag[j] in ALIKE:
            groups.setdefault((parent[j], dom.tag[j], dom.attributes[j], i == j), []).append(i)
    for (_, _, _, block), own in groups.items():
        if len(own) > 1:
            weight = [math.log1p(len(dom.text[i + 1 if block and i + 1 < n else i])) + 0.1 for i in own]
            mean = [sum(w * lp[i][k] for w, i in zip(weight, own, strict=True)) / sum(weight) for k in range(3)]
            for i in own:
                lp[i] = mean
    keep, drop, best = [0.0] * n, [0.0] * n, [0.0] * n
    mixed = [0.0] * n
    choice = [0] * n
    for i in range(n - 1, -1, -1):
        k, d = keep[i] + lp[i][ARTICLE], drop[i] + lp[i][REST]
        m = -math.inf if dom.tag[i] == LEAF else mixed[i] + lp[i][MIXED] - MIXED_COST
        best[i] = max(k, d, m)
        choice[i] = MIXED if m == best[i] else ARTICLE if k == best[i] else REST
        if i:
            keep[parent[i]] += k
            drop[parent[i]] += d
            mixed[parent[i]] += best[i]
    state = [MIXED] * n
    for i in range(n):
        above = state[parent[i]] if i else MIXED
        state[i] = choice[i] if above == MIXED else above
    return [s == ARTICLE for s in state]


_model: list[Boosted] = []


def labelled_page(seed: int) -> tuple[Dom, np.ndarray]:
    """A made page without its marks, and each node's label."""
    dom = parse(pagemaker.Maker(seed).page())
    n = len(dom.tag)
    has = np.zeros((n, 2), bool)
    for i, t in enumerate(dom.text):
        if t:
            has[i, 0 if pagemaker.MAIN in t else 1] = True
            dom.text[i] = t.replace(pagemaker.MAIN, "").replace(pagemaker.REST, "").strip()
            dom.linked[i] = min(dom.linked[i], len(dom.text[i]))
    for i in range(n - 1, 0, -1):
        has[dom.parent[i]] |= has[i]
    return dom, np.where(has.all(1), MIXED, np.where(has[:, 0], ARTICLE, REST))


def model(pages: int = TRAINING_PAGES) -> Boosted:
    """The fitted trees; once a process."""
    if not _model:
        x, y = zip(*[(features(d), label) for d, label in map(labelled_page, range(pages))], strict=True)
        _model.append(fit(np.concatenate(x), np.concatenate(y), 3))
    return _model[0]


def extract_texts(pages: list[str | None], trees: Boosted) -> list[str]:
    doms = [parse(p) for p in pages]
    x = [features(d) for d in doms]
    logp = trees.log_probabilities(np.concatenate(x)) if x else np.zeros((0, 3))
    out, at = [], 0
    for d in doms:
        n = len(d.tag)
        keep = decode(d, logp[at : at + n])
        at += n
        out.append("\n\n".join(t for t, k in zip(d.text, keep, strict=True) if t and k))
    return out


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Columns `keys` and text of every page."""
    trees = pages.sparkSession.sparkContext.broadcast(model())  # a fixed number of trees
    schema = ", ".join(f"`{c}` {dict(pages.dtypes)[c]}" for c in keys)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = extract_texts(part.column(html).to_pylist(), trees.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.array(texts, pa.string())], names=[*keys, "text"])

    return pages.select(*dict.fromkeys([*keys, html])).mapInArrow(f, f"{schema}, text string")
