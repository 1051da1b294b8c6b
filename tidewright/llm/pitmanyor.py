"""Document scores by a hierarchical Pitman-Yor language model.

Restaurants: every previous word of the training texts is a context restaurant
whose customers are the words that follow it (the begin of a text is a context,
its end a word). All contexts share one parent, the corpus restaurant, whose
customers are their tables, and whose base measure is uniform over the words of
the training texts and one unknown word. Unknown words are that one dish, so
the probabilities of a step sum to one over the events of the base model.

Seating is sampled by Gibbs sweeps over the dishes of both levels, given the
other level's state from the sweep before. In a dish's turn all its customers
leave and are seated anew. Up to FEW customers, the dish's tables are drawn from
their conditional itself; above, a Chinese-restaurant process seats them, and a
Metropolis step corrects it to the conditional (`reseat`). Its steps are some for
each table, not one for each customer. A dish with one customer has one table.
Random numbers are hashes of the dish, the sweep and the step, so no
result depends on how rows are dealt to tasks. After BURN_IN sweeps the tables
of a dish are averaged over SAMPLES more turns, and the probabilities follow
from the averages. Each level's discount is the one that the numbers of dishes
with one and two customers suggest.

Distribution: words are counted first. The HOT_WORDS most frequent ones (a
bound on what is broadcast) are coded by their rank, all others by their
64-bit hash. Pairs (context, word) are counted in each task, dealt to parts as
arrays and counted there. A pair goes to the part of its word if that is cold,
else to the part of its context if that is cold, else by both, so that a part
knows all of its cold words and contexts; the state of hot ones is broadcast,
and each part returns what it adds to it. A pair of two cold words (a link) is
held at both parts. In a sweep each part sends the other side's part the state
of its end of a link, and both seat it alike. Parts have some PART_EVENTS
training events whatever the input, and only pairs with two or more customers
take part in a sweep. For scoring, the HOT_PAIRS most frequent pairs are looked
up where the text is read; all others are dealt to their parts, and their sums
return to their texts. Pairs never seen back off to their context and word, an
unseen link by one factor at each part. Scoring goes over the documents in WAVES
parts by a hash of the text, so that one part's rows are on disk at a time. No
word, context or pair is dropped.

Null texts are empty and have the end alone. Rows with a null doc_id are learned
and scored; their held_out is null. Repeated rows are learned and scored each.
Whole texts of any length are read. Extra columns are not carried; an empty
table gives an empty result; without training rows every word is the unknown
one.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.language import held_out
from tidewright.llm import storage
from tidewright.llm.storage import discard, most_frequent
from tidewright.llm.textkernel import mix, ragged, slices, words

SAMPLES = 3
BURN_IN = 2
#: Turns of a dish in one sweep.
TURNS = 1
#: Dishes that are seated at once: those with many tables take as many steps, whatever their number.
DISHES = 500_000
HOT_WORDS = 1 << 17
HOT_PAIRS = 1 << 18
WAVES = 2
#: Training events of a part, and events that a task counts or deals out at once.
PART_EVENTS = 1 << 20
BATCH_EVENTS = 1 << 20
#: Events whose words a task counts at once.
WORD_EVENTS = 1 << 21
#: Strength of every restaurant.
STRENGTH = 1.0
#: Customers of a dish whose tables are drawn from their conditional itself.
FEW = 12
#: The last dishes of a batch go on alone, each with up to so many customers, and draw at most so many numbers at once.
LONE_DISHES = 24
LONE_CUSTOMERS = 1 << 53
LONE_DRAWS = 1 << 13
_CERTAIN = 1 - 2.0**-53
#: Key of the end of a text, and code of its begin as a context.
END = np.int64(0x2C4D6E8FA1B3C5D7)
BEGIN = HOT_WORDS
_TOP = np.int64(np.iinfo(np.int64).min)
#: Of a packed array: what its whole numbers are divided by (0: none) and whether hashes are apart; bytes used; length.
_HEAD = struct.Struct("<BBI")
_APART = 128


def materialise(df: DataFrame, name: str) -> DataFrame:
    """A step in the denser codec: tables of pairs are most of what is on disk."""
    return storage.materialise(df, name, compression="zstd")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: the series at x + 6, less six factors."""
    y = x + 6
    i = 1 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / y
    small = x < 1e7  # beyond, the factors are taken one by one to stay within range
    factors = np.log(np.where(small, x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5), 1.0))
    if small.all():
        return series - factors
    return series - np.where(small, factors, sum(np.log(x + k) for k in range(6)))


class Draws:
    """Uniform numbers for each key: a hash of key, seed and a counter."""

    def __init__(self, keys: np.ndarray, seed: int) -> None:
        self.keys = mix(keys.view(np.uint64) ^ mix(np.array([seed], np.uint64)))
        self.count = 0

    def __call__(self, at: np.ndarray) -> np.ndarray:
        self.count += 1
        step = np.uint64((self.count * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        return self._uniform(self.keys[at] + step)

    def ahead(self, at: int, count: int, n: int) -> np.ndarray:
        """The n numbers of one key that follow a count."""
        return self._uniform(self.keys[at] + np.arange(count + 1, count + n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of(self, some: np.ndarray) -> Draws:
        """The same numbers for some of the keys."""
        out = Draws.__new__(Draws)
        out.keys, out.count = self.keys[some], 0
        return out

    @staticmethod
    def _uniform(x: np.ndarray) -> np.ndarray:
        return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _seat_alone(seated: float, c: float, tables: float, strength: float, discount: float, draws: Draws, dish: int) -> float:
    """Tables of one dish whose first customers sit, in the steps of `seat`."""
    n, u = 64, iter(())
    count = draws.count
    while seated < c:
        first = next(u, None)
        if first is None:
            n = min(2 * n, LONE_DRAWS)
            u = iter(draws.ahead(dish, count, n).tolist())
            count += n
            first = next(u)
        own = strength + seated
        at = seated + math.log(first) // math.log1p(-min((strength + discount * tables) / own, _CERTAIN))
        if next(u) * (strength + at) < own and at < c:
            tables += 1
        seated = at + 1
    return tables


def seat(c: np.ndarray, strength: np.ndarray, discount: float, draws: Draws) -> np.ndarray:
    """Tables of c customers by the Chinese-restaurant process of each strength (above -discount).

    Until the next new table the chance to open one falls with each customer. So the chance of the next customer gives
    a waiting time, and who comes after it opens a table by the ratio of the own chance to that one: a step for some
    tables, not for every customer.
    """
    t, seated = np.ones(len(c)), np.ones(len(c))
    live = np.flatnonzero(c > 1)
    while len(live):
        if len(live) <= LONE_DISHES and c[live].max() <= LONE_CUSTOMERS:
            for dish in live.tolist():
                t[dish] = _seat_alone(float(seated[dish]), float(c[dish]), float(t[dish]), float(strength[dish]), discount, draws, dish)
            break
        s, i, tables, most = strength[live], seated[live], t[live], c[live]
        at = i + np.minimum(np.log(draws(live)) // np.log1p(-np.minimum((s + discount * tables) / (s + i), _CERTAIN)), most)
        t[live] = tables + ((draws(live) * (s + at) < s + i) & (at < most))
        seated[live] = at + 1
        live = live[at + 1 < most]
    return t


def ways(discount: float) -> np.ndarray:
    """Ways to seat so many customers (up to FEW, by row) at so many tables: generalised Stirling numbers."""
    out = np.zeros((FEW + 1, FEW + 1))
    out[1, 1] = 1
    for n in range(1, FEW):
        out[n + 1, 1:] = out[n, :-1] + np.maximum(n - discount * np.arange(1, FEW + 1), 0) * out[n, 1:]
    return out


def _reseat_few(c: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, draws: Draws, turns: int) -> np.ndarray:
    """What `reseat` gives, for at most FEW customers: every turn draws from the conditional itself."""
    t, total, table = np.ones(len(c)), np.full(len(c), float(turns)), ways(discount)
    for n in range(2, FEW + 1):
        own = np.flatnonzero(c == n)
        if not len(own):
            continue
        weight, whole = np.ones(len(own)), np.empty((n, len(own)))
        whole[0] = table[n, 1]
        for k in range(1, n):
            weight *= (others[own] + discount * k) * base[own]
            whole[k] = whole[k - 1] + table[n, k + 1] * weight
        total[own] = 0
        for turn in range(turns):
            draws.count = turn << 32
            u = draws(own) * whole[-1]
            t[own] = 1.0 + (whole[:-1] < u).sum(axis=0)
            total[own] += t[own]
    return np.stack([t, total])


def expected_tables(c: np.ndarray, strength: np.ndarray, discount: float) -> np.ndarray:
    g = log_gamma(strength + discount + c) + log_gamma(strength + 1) - log_gamma(strength + c) - log_gamma(strength + discount)
    return np.exp(g) / discount - strength / discount


def _reseat_many(c: np.ndarray, t: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, draws: Draws, turns: int) -> np.ndarray:
    """What `reseat` gives, for any number of customers: a process proposes tables, the rest of the ratio decides."""
    a = others * base
    s = np.maximum(a, -0.9 * discount)
    for _ in range(2):  # a strength whose later customers open tables about as often as the conditional's
        s = np.maximum(a - discount * np.minimum(expected_tables(c, np.maximum(s, -0.9 * discount), discount), c), -0.9 * discount)
    log_base = np.log(np.maximum(base, 1e-300))

    def weight(t: np.ndarray) -> np.ndarray:
        target = t * (np.log(discount) + log_base) + log_gamma(others / discount + t) - log_gamma(others / discount)
        return target - (t - 1) * np.log(discount) - log_gamma(s / discount + t) + log_gamma(s / discount + 1)

    every = np.arange(len(c))
    total, now = np.zeros(len(c)), weight(t)
    for k in range(turns):
        new = seat(c, s, discount, draws)
        draws.count = (k + 1) << 32  # so that no dish's draws depend on how many steps others take
        then = weight(new)
        accept = np.log(draws(every)) < then - now
        t, now = np.where(accept, new, t), np.where(accept, then, now)
        total += t
    return np.stack([t, total])


def reseat(c: np.ndarray, t: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, draws: Draws, turns: int) -> np.ndarray:
    """Tables after `turns` turns in which a dish's customers all leave and sit down anew, and their sum over the turns.

    The conditional of t tables weighs the ways to seat c customers at t tables by the product over k < t of
    (others + discount * k) * base, where `others` is the restaurant's strength with the tables of all other dishes.
    It is drawn from directly for few customers. Else a Chinese-restaurant process proposes tables with the same number
    of ways; the rest of the ratio decides.
    """
    out, many = _reseat_few(c, others, base, discount, draws, turns), np.flatnonzero(c > FEW)
    if len(many):
        out[:, many] = _reseat_many(c[many], t[many], others[many], base[many], discount, draws.of(many), turns)
    return out


def hashed_events(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Key of every event of the texts (its words and its end), and the first event of each text."""
    _, _, _, h, first = words(texts)
    n, k = len(h), len(texts)
    w = np.full(n + k, END)
    w[np.arange(n) + np.repeat(np.arange(k), np.diff(first))] = h.view(np.int64)
    return w, first + np.arange(k + 1)


class Slots:
    """Places of 64-bit hashes among keys: by the first bits, and by bisection for keys that share them with another one."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = int(len(keys)).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        slot, every = (keys.view(np.uint64) >> self.shift).view(np.int64), np.arange(len(keys), dtype=np.int32)
        self.first = np.zeros(1 << bits, np.int32)
        self.first[slot] = every
        lost = np.flatnonzero(self.first[slot] != every)
        self.rest = lost[np.argsort(keys[lost])]
        self.rest_keys = keys[self.rest]
        self.shared = np.zeros(1 << bits, bool)
        self.shared[slot[lost]] = True

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place for each wanted key, and whether the key is there."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        slot = (wanted.view(np.uint64) >> self.shift).view(np.int64)
        at = self.first[slot].astype(np.int64)
        there = self.keys[at] == wanted
        if len(self.rest):
            more = np.flatnonzero(~there & self.shared[slot])
            found = np.minimum(np.searchsorted(self.rest_keys, wanted[more]), len(self.rest) - 1)
            at[more], there[more] = self.rest[found], self.rest_keys[found] == wanted[more]
        return at, there


def coded(w: np.ndarray, hot: np.ndarray | Slots) -> np.ndarray:
    """Rank of hot words, and for others the hash with its top bit set."""
    at, there = (hot if isinstance(hot, Slots) else Slots(hot))(w)
    return np.where(there, at, w | _TOP)


def contexts(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The code before each event."""
    u = np.append(BEGIN, w)[: len(w)]
    u[first[:-1]] = BEGIN
    return u


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit key of a context and a word."""
    return (mix(u.view(np.uint64)) * np.uint64(3) + mix(w.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """key and c of every word of the texts, their ends included."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        key, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], names=["key", "c"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, texts in slices(batch):
                held.append(hashed_events(texts)[0])
                n += len(held[-1])
                if n >= WORD_EVENTS:
                    yield counted(held)
                    held, n = [], 0
        if n:
            yield counted(held)

    return docs.select("text").mapInArrow(f, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def part_of(u: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    """Part of each pair: that of its word if cold, else of its context if cold, else by both."""
    own = np.where(w < 0, w, np.where(u < 0, u, pair_key(u, w)))
    return (mix(own.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def context_part(u: np.ndarray, parts: int) -> np.ndarray:
    """Part of cold contexts."""
    return (mix(u.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def ddl(scalars: str, fields: dict[str, str]) -> str:
    return ", ".join([scalars, *(f"{name} binary" for name in fields)])


def _planes(a: np.ndarray, kind: str, used: int) -> bytes:
    """The first bytes of all values, then the second ones, `used` of them: small numbers compress well."""
    return np.ascontiguousarray(a, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)[:, :used].T.tobytes()


def packed(a: np.ndarray, kind: str) -> bytes:
    """An array's bytes: whole numbers (or SAMPLES-ths) below 2^31 by the bytes they use, hashes apart, fractions as they are."""
    if not len(a):
        return b""
    divisor, apart = 1, b""
    if kind == "f8":
        for divisor in (1, SAMPLES):
            whole = np.rint(a * divisor)
            if (whole / divisor == a).all() and whole.min() >= 0 and whole.max() < 1 << 31:
                a = whole.astype(np.int64)
                break
        else:
            return _HEAD.pack(0, 8, len(a)) + _planes(a, "f8", 8)
    n, small = len(a), (a >= 0) & (a < 1 << 31)
    if not small.all():
        divisor, apart = divisor | _APART, np.packbits(small).tobytes() + np.ascontiguousarray(a[~small], "i8").tobytes()
        a = a[small]
    used = (int(a.max(initial=0)).bit_length() + 7) // 8
    return _HEAD.pack(divisor, used, n) + apart + _planes(a, "u4", used)


def unpacked(b: bytes | None, kind: str) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    divisor, used, n = _HEAD.unpack_from(b)
    body = np.frombuffer(b, np.uint8, offset=_HEAD.size)
    if not divisor:
        return np.ascontiguousarray(body.reshape(8, n).T).view("f8").ravel()
    mask = body[: (n + 7) // 8 if divisor & _APART else 0]
    small = np.unpackbits(mask, count=n).view(bool) if len(mask) else np.full(n, True)
    some = int(small.sum())
    whole = np.zeros(some, np.int64)
    for k, plane in enumerate(body[len(body) - used * some :].reshape(used, some)):
        whole |= plane.astype(np.int64) << (8 * k)
    if some < n:
        out = np.empty(n, np.int64)
        out[small], out[~small] = whole, body[len(mask) : len(mask) + 8 * (n - some)].view(np.int64)
        whole = out
    return whole if kind == "i8" else whole / (divisor & ~_APART)


def _rows(rows: list[dict], fields: dict[str, str]) -> pa.Table:
    """Rows of (part, kind, arrays by name) as a table."""
    out = {name: pa.array([r[name] for r in rows], pa.int32()) for name in ("part", "kind")}
    return pa.table(out | {name: pa.array([packed(r[name], kind) if name in r else None for r in rows], pa.binary()) for name, kind in fields.items()})


def _arrays(table: pa.Table, fields: dict[str, str], kind: int) -> dict[str, np.ndarray]:
    """Arrays of the table's rows of one kind, put together."""
    own = [i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind]
    return {name: np.concatenate([np.zeros(0, t), *(unpacked(table.column(name)[i].as_py(), t) for i in own)]) for name, t in fields.items()}


def _dealt(part: np.ndarray, kind: int, **arrays: np.ndarray) -> list[dict]:
    """A row for each part with its share of the arrays."""
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    ends = np.append(first, len(part))[1:]
    return [{"part": int(p), "kind": kind, **{k: v[order[i:j]] for k, v in arrays.items()}} for p, i, j in zip(found, first, ends, strict=True)]


def find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, default: float = 0.0) -> np.ndarray:
    """Values of the wanted keys; the keys are hashes in any order."""
    if not len(keys) or not len(wanted):
        return np.full(len(wanted), default, values.dtype)
    at, there = Slots(keys)(wanted)
    return np.where(there, values[at], values.dtype.type(default))


COUNTED = {"u": "i8", "w": "i8", "c": "i8"}
#: Of a part. SEATS: pairs with two or more customers, links (the pairs of two cold words, at the part of their context),
#: cold words (customers and tables; of single pairs in w1) and cold contexts. SINGLES: pairs with one customer.
#: TO_WORDS and TO_CONTEXTS: what one side of a link says to the other. HOT: what the part adds to a slice of the hot words.
SEATS, SINGLES, TO_WORDS, TO_CONTEXTS, HOT, SUMS = range(6)
STEP = {"u": "i8", "w": "i8", "c": "i8", "t": "f8", "bu": "i8", "bw": "i8", "bc": "i8", "bt": "f8", "wk": "i8", "wc": "i8", "w1": "i8", "wn": "f8", "wt": "f8", "uk": "i8", "uc": "i8", "u1": "i8", "un": "f8", "key": "i8", "x": "f8", "y": "f8"}
_STEP = ddl("part int, kind int", STEP)
PARTS = {"u": "i8", "w": "i8", "c": "i8", "t": "f8", "su": "i8", "sw": "i8", "lk": "i8", "lc": "f8", "lt": "f8", "wk": "i8", "wc": "i8", "wn": "f8", "wt": "f8", "p": "f8", "uk": "i8", "uc": "i8", "un": "f8", "back": "f8", "links": "i8"}
_SLICE = HOT_WORDS // 8 + 1


def count_pairs(docs: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """Pairs of the texts (u context, w word, c) by part: kind 0, and once more as links (kind 1) if both are cold."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, w = (np.concatenate(x) for x in zip(*held, strict=True))
        _, one, c = np.unique(pair_key(u, w), return_index=True, return_counts=True)
        u, w = u[one], w[one]
        both = (u < 0) & (w < 0)
        rows = _dealt(part_of(u, w, parts), 0, u=u, w=w, c=c) + _dealt(context_part(u[both], parts), 1, u=u[both], w=w[both], c=c[both])
        return _rows(rows, COUNTED)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, words_at = [], 0, Slots(shared.value)
        for batch in batches:
            for _, texts in slices(batch):
                w, first = hashed_events(texts)
                w = coded(w, words_at)
                held.append((contexts(w, first), w))
                n += len(w)
                if n >= BATCH_EVENTS:
                    yield from counted(held).to_batches()
                    held, n = [], 0
        if n:
            yield from counted(held).to_batches()

    return docs.select("text").mapInArrow(f, ddl("part int, kind int", COUNTED))


def _summed(counted: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, in the order of its key."""
    _, one, which = np.unique(pair_key(counted["u"], counted["w"]), return_index=True, return_inverse=True)
    return counted["u"][one], counted["w"][one], np.bincount(which, counted["c"], len(one)).astype(np.int64)


def _of(keys: np.ndarray, own: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of the values by key."""
    at = Slots(keys)(own)[0]
    return [np.bincount(at, v, len(keys)) for v in values]


def _hot_rows(u: np.ndarray, w: np.ndarray, of_words: dict[str, np.ndarray], of_contexts: dict[str, np.ndarray]) -> list[dict]:
    """What pairs add to the hot words, by slices."""
    sums = {k: np.bincount(w[w >= 0], v[w >= 0], 8 * _SLICE) for k, v in of_words.items()}
    sums |= {k: np.bincount(u[u >= 0], v[u >= 0], 8 * _SLICE) for k, v in of_contexts.items()}
    return [{"part": i, "kind": HOT, **{k: v[i * _SLICE : (i + 1) * _SLICE] for k, v in sums.items()}} for i in range(8)]


def _messages(s: dict[str, np.ndarray], parts: int, whole: bool) -> list[dict]:
    """What cold words and cold contexts say to the other side of their links; of single pairs in `whole` only."""
    a = (s["u"] < 0) & (s["w"] < 0)
    u, w = s["u"][a], s["w"][a]
    rows = _dealt(context_part(u, parts), TO_CONTEXTS, key=pair_key(u, w), x=find(s["wk"], w, s["wn"]), y=find(s["wk"], w, s["wt"]))
    b = np.full(len(s["bu"]), True) if whole else s["bc"] > 1
    u, w = s["bu"][b], s["bw"][b]
    return rows + _dealt(part_of(u, w, parts), TO_WORDS, key=pair_key(u, w), x=find(s["uk"], u, s["uc"]).astype(float), y=find(s["uk"], u, s["un"]))


def _sums(s: dict[str, np.ndarray], c: np.ndarray) -> dict:
    """Numbers of pairs with one and two customers, of cold words with as many, and sums of cold customers and tables."""
    n = s["wn"]
    return {"part": 0, "kind": SUMS, "x": np.array([(c == 1).sum(), (c == 2).sum(), (n == 1).sum(), (n == 2).sum(), n.sum(), s["wt"].sum()], float)}


def first_seats(counted: DataFrame, parts: int) -> DataFrame:
    """Each part with one table a pair, what it says to others and what it adds to hot words."""

    def f(_: tuple, table: pa.Table) -> pa.Table:
        u, w, c = _summed(_arrays(table, COUNTED, 0))
        bu, bw, bc = _summed(_arrays(table, COUNTED, 1))
        part = table.column("part")[0].as_py()
        one = (c == 1).astype(np.int64)
        word = w < 0
        context = (u < 0) & (w >= 0)
        wk, uk = np.unique(w[word]), np.unique(np.append(u[context], bu))
        wc, w1, wn = _of(wk, w[word], c[word], one[word], np.ones(word.sum()))
        uc, u1, un = _of(uk, np.append(u[context], bu), np.append(c[context], bc), np.append(one[context], bc == 1), np.ones(context.sum() + len(bu)))
        m = c > 1
        s = {"u": u[m], "w": w[m], "c": c[m], "t": np.ones(m.sum()), "bu": bu, "bw": bw, "bc": bc, "bt": np.ones(len(bu)), "wk": wk, "wc": wc, "w1": w1, "wn": wn, "wt": np.ones(len(wk)), "uk": uk, "uc": uc, "u1": u1, "un": un}
        every = np.ones(len(c))
        rows = [{"part": part, "kind": SEATS, **s}, {"part": part, "kind": SINGLES, "u": u[~m], "w": w[~m]}, _sums(s, c)]
        rows += _hot_rows(u, w, {"wc": c, "w1": one, "wn": every}, {"uc": c, "u1": one, "un": every}) + _messages(s, parts, False)
        return _rows(rows, STEP)

    return counted.groupBy("part").applyInArrow(f, _STEP)


@dataclass
class Rates:
    """What both levels share."""

    discount: float  # of the corpus restaurant
    context_discount: float
    customers: float  # tables of all contexts
    tables: float
    distinct: int  # V

    @property
    def unknown(self) -> float:
        """Corpus probability of the unknown word, and of any dish through the base measure."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers) / (self.distinct + 1)

    def word_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.maximum(customers - self.discount * tables, 0) / (STRENGTH + self.customers) + self.unknown

    def backoff(self, uc: np.ndarray, ut: np.ndarray) -> np.ndarray:
        """Weight that a context gives to the corpus restaurant."""
        return (STRENGTH + self.context_discount * ut) / (STRENGTH + uc)


@dataclass
class Model(Rates):
    total: int = 0  # N
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # keys of hot words in order
    parts: DataFrame | None = None  # pairs with their probabilities, cold words and contexts, by part
    number: int = 1  # of parts
    arrays: dict[str, np.ndarray] = field(default_factory=dict)  # of hot words and the begin, by code

    def rates(self) -> Rates:
        return Rates(self.discount, self.context_discount, self.customers, self.tables, self.distinct)

    @property
    def state(self) -> DataFrame:
        """key (code), c, customers, tables of every word; as a context: uc, ut."""
        names = "key long, c long, customers double, tables double, uc long, ut double"
        a = self.arrays
        some = np.flatnonzero((a["c"] > 0) | (a["uc"] > 0))
        hot = self.parts.sparkSession.createDataFrame(pd.DataFrame({"key": some, **{k: a[k][some] for k in ("c", "customers", "tables", "uc", "ut")}}).astype({"c": int, "uc": int}), names)

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    s = {k: unpacked(batch.column(k)[i].as_py(), PARTS[k]) for k in ("wk", "wc", "wn", "wt", "uk", "uc", "un")}
                    key = np.union1d(s["wk"], s["uk"])
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(find(s[k], key, s[v])) for k, v in (("wk", "wc"), ("wk", "wn"), ("wk", "wt"), ("uk", "uc"), ("uk", "un")))], names=["key", "c", "customers", "tables", "uc", "ut"])

        return self.parts.select("wk", "wc", "wn", "wt", "uk", "uc", "un").mapInArrow(f, names).unionByName(hot)


class Seen:
    """The pairs of a part: those with several customers and single ones."""

    def __init__(self, s: dict[str, np.ndarray], a: dict[str, np.ndarray], r: Rates) -> None:
        self.s, self.a, self.r = s, a, r

    def q(self, u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Probabilities of pairs with c customers at t tables; without customers, by the word's and the context's state alone."""
        s, a, r = self.s, self.a, self.r
        uc, ut = (a[k][np.maximum(u, 0)] for k in ("uc", "ut"))
        own = np.flatnonzero((u < 0) & (w >= 0))
        uc[own], ut[own] = (find(s["uk"], u[own], s[k]) for k in ("uc", "un"))
        link = np.flatnonzero((u < 0) & (w < 0))
        uc[link], ut[link] = (find(s["lk"], pair_key(u[link], w[link]), s[k]) for k in ("lc", "lt"))
        p, cold = a["p"][np.maximum(w, 0)], np.flatnonzero(w < 0)
        p[cold] = find(s["wk"], w[cold], s["p"], r.unknown)
        return np.maximum(c - r.context_discount * t, 0.0) / (STRENGTH + uc) + r.backoff(uc, ut) * p

    def met(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Probabilities of any pairs of the part. What an unseen link's context weighs is left out: its part adds it."""
        key, c, t = pair_key(u, w), np.zeros(len(u)), np.zeros(len(u))
        at, there = Slots(pair_key(np.append(self.s["u"], self.s["su"]), np.append(self.s["w"], self.s["sw"])))(key)
        single = at >= len(self.s["u"])
        c[there & single] = t[there & single] = 1
        on = np.flatnonzero(there & ~single)
        c[on], t[on] = self.s["c"][at[on]], self.s["t"][at[on]]
        return self.q(u, w, c, t)


def table_rows(m: Model, least: int = 1) -> DataFrame:
    """u, w, c (count), q (probability) and wc (count of a cold word) of every pair with `least` customers (1 or 2)."""
    r, names = m.rates(), ["u", "w", "c", "t", "wk", "wc", "p", "uk", "uc", "un", "lk", "lc", "lt", *(["su", "sw"] if least < 2 else [])]
    shared = m.parts.sparkSession.sparkContext.broadcast({k: m.arrays[k] for k in ("uc", "ut", "p")})

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = {"su": np.zeros(0, np.int64), "sw": np.zeros(0, np.int64)} | {k: unpacked(batch.column(k)[i].as_py(), PARTS[k]) for k in names}
                one = np.ones(len(s["su"]), np.int64)
                u, w, c, t = (np.append(*x) for x in ((s["u"], s["su"]), (s["w"], s["sw"]), (s["c"], one), (s["t"], one)))
                wc = pa.array(find(s["wk"], w, s["wc"]).astype(np.int64), mask=w >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(c), pa.array(Seen(s, shared.value, r).q(u, w, c, t)), wc], names=["u", "w", "c", "q", "wc"])

    return m.parts.select(*names).mapInArrow(f, "u long, w long, c long, q double, wc long")


def _discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 else 0.5


def corpus_tables(key: np.ndarray, k: np.ndarray, before: np.ndarray, r: Rates, sweep: int) -> np.ndarray:
    """Tables of words with k customers in the corpus restaurant, seated anew; `before` has those of the last sweep."""
    whole = np.rint(k)
    t = np.where(whole > 0, np.maximum(np.minimum(before, whole), 1.0), 0.0)
    for some in np.array_split(np.flatnonzero(whole > 1), 1 + len(key) // DISHES):
        if len(some):
            others = STRENGTH + r.discount * np.maximum(r.tables - t[some], 0)
            t[some] = reseat(whole[some], t[some], others, np.full(len(some), 1 / (r.distinct + 1)), r.discount, Draws(key[some], 2 * sweep), TURNS)[0]
    return np.minimum(t, k)


def context_tables(u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray, ut: np.ndarray, p: np.ndarray, r: Rates, sweep: int, turns: int) -> np.ndarray:
    """Sums over the turns of the tables of pairs with two or more customers, seated anew."""
    out = t.copy()
    for some in np.array_split(np.arange(len(u)), 1 + len(u) // DISHES):
        if len(some):
            others = STRENGTH + r.context_discount * np.maximum(ut[some] - t[some], 0)
            out[some] = reseat(c[some].astype(float), t[some], others, p[some], r.context_discount, Draws(pair_key(u[some], w[some]), 2 * sweep + 1), turns)[1]
    return out


def _heard(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = _arrays(table.select(["kind", "key", "x", "y"]), {k: STEP[k] for k in ("key", "x", "y")}, kind)
    order = np.argsort(s["key"])
    return s["key"][order], s["x"][order], s["y"][order]


def swept(step: DataFrame, m: Model, sweep: int, last: bool) -> DataFrame:
    """All parts after one more sweep; the last one averages over SAMPLES turns."""
    r, parts, turns = m.rates(), m.number, SAMPLES if last else TURNS
    shared = step.sparkSession.sparkContext.broadcast({k: m.arrays[k] for k in ("ut", "p")})

    def f(_: tuple, seats: pa.Table, said: pa.Table) -> pa.Table:
        a, s = shared.value, _arrays(seats, STEP, SEATS)
        part = seats.column("part")[0].as_py()
        u, w, c, t = (s[k] for k in ("u", "w", "c", "t"))
        key, _, ut = _heard(said, TO_WORDS)
        here = np.where(w >= 0, find(s["uk"], u, s["un"]), find(key, pair_key(u, w), ut))
        p = np.where(w >= 0, a["p"][np.maximum(w, 0)], find(s["wk"], w, r.word_probability(s["wn"], s["wt"])))
        total = context_tables(u, w, c, t, np.where(u >= 0, a["ut"][np.maximum(u, 0)], here), p, r, sweep, turns)
        b = s["bc"] > 1
        bu, bw = s["bu"][b], s["bw"][b]
        key, wn, wt = _heard(said, TO_CONTEXTS)
        links = context_tables(bu, bw, s["bc"][b], s["bt"][b], find(s["uk"], bu, s["un"]), find(key, pair_key(bu, bw), r.word_probability(wn, wt)), r, sweep, turns)
        word, context = w < 0, (u < 0) & (w >= 0)
        wn = s["w1"] + _of(s["wk"], w[word], total[word])[0] / turns
        un = s["u1"] + _of(s["uk"], np.append(u[context], bu), np.append(total[context], links))[0] / turns
        bt = s["bt"].copy()
        bt[b] = links / turns
        s |= {"t": total / turns, "bt": bt, "wt": corpus_tables(s["wk"], wn, s["wt"], r, sweep), "wn": wn, "un": un}
        rows = [{"part": part, "kind": SEATS, **{k: v for k, v in s.items() if k not in ("key", "x", "y")}}, _sums(s, c)]
        return _rows(rows + _hot_rows(u, w, {"wn": total}, {"un": total}) + _messages(s, parts, last), STEP)

    said = step.where(F.col("kind").isin(TO_WORDS, TO_CONTEXTS))
    return step.where(F.col("kind") == SEATS).groupBy("part").cogroup(said.groupBy("part")).applyInArrow(f, _STEP)


def _gathered_hot(step: DataFrame, m: Model, sweep: int, turns: int) -> dict[str, np.ndarray]:
    """What all parts add to the hot words and the begin (8 slices), and after the first step their new tables."""
    fixed, r = {k: m.arrays[k] for k in ("w1", "u1", "tables") if m.arrays}, m.rates()
    shared = step.sparkSession.sparkContext.broadcast(fixed)
    names = ("wc", "w1", "wn", "uc", "u1", "un")

    def f(key: tuple, table: pa.Table) -> pa.Table:
        s = {k: np.zeros(_SLICE) for k in names}
        for k in names:
            for x in table.column(k):
                if x.as_py():
                    s[k] += unpacked(x.as_py(), STEP[k])
        if sweep:
            own = slice(key[0].as_py() * _SLICE, (key[0].as_py() + 1) * _SLICE)
            at, held = np.arange(own.start, own.stop), {k: v[own] for k, v in shared.value.items()}
            s["wn"], s["un"] = held["w1"] + s["wn"] / turns, held["u1"] + s["un"] / turns
            s["wt"] = corpus_tables(at, s["wn"], held["tables"], r, sweep)
        return _rows([{"part": key[0].as_py(), "kind": HOT, **s}], STEP)

    out = {k: np.zeros(8 * _SLICE) for k in (*names, "wt")}
    for row in step.where(F.col("kind") == HOT).groupBy("part").applyInArrow(f, _STEP).collect():
        for k in out:
            if row[k]:
                out[k][row["part"] * _SLICE : (row["part"] + 1) * _SLICE] = unpacked(bytes(row[k]), STEP[k])
    return out


def _take_state(step: DataFrame, m: Model, sweep: int, turns: int = 1) -> None:
    """Set the model's rates and arrays from a step."""
    hot, rows = _gathered_hot(step, m, sweep, turns), [unpacked(bytes(x["x"]), "f8") for x in step.where(F.col("kind") == SUMS).select("x").collect()]
    n1, n2, r1, r2, customers, tables = np.sum(rows, axis=0) if rows else np.zeros(6)
    if not sweep:
        m.context_discount = _discount(n1, n2)
        m.discount = _discount(r1 + (hot["wn"] == 1).sum(), r2 + (hot["wn"] == 2).sum())
        m.arrays = {"c": hot["wc"], "w1": hot["w1"], "uc": hot["uc"], "u1": hot["u1"]}
        hot["wt"] = (hot["wn"] > 0).astype(float)
    m.customers, m.tables = float(customers + hot["wn"].sum()), float(tables + hot["wt"].sum())
    m.arrays |= {"customers": hot["wn"], "tables": hot["wt"], "ut": hot["un"]}
    m.arrays |= {"p": m.word_probability(hot["wn"], hot["wt"]), "back": m.backoff(m.arrays["uc"], hot["un"])}


def whole_parts(step: DataFrame, singles: DataFrame, m: Model) -> DataFrame:
    """Every part with all that the probabilities of its pairs follow from."""
    r = m.rates()

    def f(_: tuple, seats: pa.Table, said: pa.Table) -> pa.Table:
        s, one = _arrays(seats, STEP, SEATS), _arrays(seats, {"u": "i8", "w": "i8"}, SINGLES)
        lk, lc, lt = _heard(said, TO_WORDS)
        own = {"su": one["u"], "sw": one["w"], "lk": lk, "lc": lc, "lt": lt, "p": r.word_probability(s["wn"], s["wt"]), "back": r.backoff(s["uc"], s["un"]), "links": np.sort(pair_key(s["bu"], s["bw"]))}
        return _rows([{"part": seats.column("part")[0].as_py(), "kind": SEATS, **{x: s[x] for x in ("u", "w", "c", "t", "wk", "wc", "wn", "wt", "uk", "uc", "un")}, **own}], PARTS)

    left = step.where(F.col("kind") == SEATS).unionByName(singles)
    said = step.where(F.col("kind") == TO_WORDS)
    return left.groupBy("part").cogroup(said.groupBy("part")).applyInArrow(f, ddl("part int, kind int", PARTS))


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and u, w, c (count), q (probability) and wc (count of a cold word) of every pair of docs(text)."""
    counted = materialise(count_words(docs), "words")
    n, v = counted.agg(F.sum("c"), F.count(F.lit(1))).first()
    hot = np.sort(most_frequent(counted, "c", HOT_WORDS).select("key").toPandas()["key"].to_numpy().astype(np.int64))
    discard(counted)
    m = Model(0.5, 0.5, 0.0, 0.0, int(v), int(n or 0), hot, number=1 + int(n or 0) // PART_EVENTS)
    first = step = materialise(first_seats(count_pairs(docs, hot, m.number), m.number), "seats")
    _take_state(step, m, 0)
    for sweep in range(1, BURN_IN + 2):
        last = sweep > BURN_IN
        old, step = step, materialise(swept(step, m, sweep, last), "seats")
        if old is not first:
            discard(old)
        _take_state(step, m, sweep, SAMPLES if last else TURNS)
    m.parts = materialise(whole_parts(step, first.where(F.col("kind") == SINGLES), m), "probabilities")
    discard(first, step)
    return m, table_rows(m)


GATHERED = {"rows": "i8", "u": "i8", "w": "i8"}
#: Rows of texts in what _gather returns.
TEXT = 2
_GATHERED = ddl("part int, kind int", GATHERED) + ", row long, doc_id long, n_tokens long, n_known long, base_sum double, p_sum double"
SUMMED = {"rows": "i8", "known": "i8", "base": "f8", "p": "f8"}


def _gather(batches: Iterator[pa.RecordBatch], hot: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, ...], parts: int) -> Iterator[pa.RecordBatch]:
    """For each text a row with the sums that need no join, and its other pairs by part; links are sent to both parts.

    Base sums need the counts of cold words, so only pairs that are known here or have a hot word add to them.
    """
    pair_keys, pair_q, pair_c = pairs
    words_at, pairs_at = Slots(hot), Slots(pair_keys)

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.Table:
        row, u, w = (np.concatenate(x) for x in zip(*held, strict=True))
        both = np.flatnonzero((u < 0) & (w < 0))
        rows = _rows(_dealt(part_of(u, w, parts), 0, rows=row, u=u, w=w) + _dealt(context_part(u[both], parts), 1, rows=row[both], u=u[both], w=w[both]), GATHERED)
        for name, kind in (("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("p_sum", pa.float64())):
            rows = rows.append_column(name, pa.nulls(rows.num_rows, kind))
        return rows

    held, waiting = [], 0
    for batch in batches:
        for part, texts in slices(batch):
            w, first = hashed_events(texts)
            w = coded(w, words_at)
            u = contexts(w, first)
            n, k, size = len(w), len(texts), np.diff(first)
            owner = np.repeat(np.arange(k), size)
            key = pair_key(u, w)
            known, q, c = np.zeros(n, bool), np.ones(n), np.zeros(n)
            if len(pair_keys):
                at, known = pairs_at(key)
                q, c = np.where(known, pair_q[at], 1.0), np.where(known, pair_c[at], 0.0)
            c = np.where(w >= 0, counts[np.maximum(w, 0)], c)
            sure = known | (w >= 0)
            n_known, base_sum, p_sum = (np.bincount(owner, x, k) for x in (sure.astype(float), np.where(sure, np.log10(c + 0.5), 0.0), np.log10(q)))
            row = part.column("row").to_numpy()
            # the other pairs
            rest = np.flatnonzero(~known)
            held.append((row[owner[rest]], u[rest], w[rest]))
            waiting += len(rest)
            blank = [pa.nulls(k, pa.binary())] * len(GATHERED)
            own = [pa.array((row >> 33).astype(np.int32)), pa.array(np.full(k, TEXT, np.int32)), *blank, pa.array(row), part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base_sum), pa.array(p_sum)]
            yield pa.RecordBatch.from_arrays(own, names=["part", "kind", *GATHERED, "row", "doc_id", "n_tokens", "n_known", "base_sum", "p_sum"])
            if waiting >= BATCH_EVENTS:
                yield from dealt(held).to_batches()
                held, waiting = [], 0
    if waiting:
        yield from dealt(held).to_batches()


def _met(gathered: DataFrame, m: Model) -> DataFrame:
    """Sums of the texts' pairs in each part, by the group of rows of a text (part)."""
    r = m.rates()
    shared = gathered.sparkSession.sparkContext.broadcast({k: m.arrays[k] for k in ("uc", "ut", "p")})
    names = ("u", "w", "c", "t", "su", "sw", "lk", "lc", "lt", "wk", "wc", "p", "uk", "uc", "un", "back", "links")

    def f(_: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([], SUMMED)
        s = {k: np.concatenate([np.zeros(0, PARTS[k]), *(unpacked(x.as_py(), PARTS[k]) for x in own.column(k))]) for k in names}
        g, b = _arrays(texts, GATHERED, 0), _arrays(texts, GATHERED, 1)
        p = np.log10(Seen(s, shared.value, r).met(g["u"], g["w"]))
        cold = np.flatnonzero(g["w"] < 0)
        wc = find(s["wk"], g["w"][cold], s["wc"])
        unseen = find(s["links"], pair_key(b["u"], b["w"]), np.ones(len(s["links"]))) == 0
        more = np.where(unseen, np.log10(find(s["uk"], b["u"], s["back"], 1.0)), 0.0)
        which, rows = pd.factorize(np.append(g["rows"], b["rows"]))
        n, here = len(rows), which[cold]
        known, base, p = np.bincount(here, wc > 0, n), np.bincount(here, np.log10(wc + 0.5), n), np.bincount(which, np.append(p, more), n)
        return _rows(_dealt(rows >> 33, 0, rows=rows, known=known, base=base, p=p), SUMMED)

    pairs = gathered.where(F.col("kind") != TEXT).select("part", "kind", *GATHERED)
    own = m.parts.select("part", *names)
    return pairs.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(f, ddl("part int, kind int", SUMMED))


def _scored(gathered: DataFrame, met: DataFrame, norm: float) -> DataFrame:
    """The texts' rows with all sums."""

    def f(_: tuple, texts: pa.Table, sums: pa.Table) -> pa.Table:
        row = texts.column("row").to_numpy()
        order = np.argsort(row)
        s = _arrays(sums, SUMMED, 0)
        at = order[np.searchsorted(row[order], s["rows"])]
        known, base, p = (np.bincount(at, s[k], len(row)) for k in ("known", "base", "p"))
        n, n_known, base_sum, p_sum = (texts.column(k).to_numpy() for k in ("n_tokens", "n_known", "base_sum", "p_sum"))
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": n, "n_known": n_known + known.astype(np.int64), "base_score": base_sum + base - n * norm, "score": p_sum + p})

    texts = gathered.where(F.col("kind") == TEXT).select("part", "row", "doc_id", "n_tokens", "n_known", "base_sum", "p_sum")
    return texts.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(f, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, m: Model, table: DataFrame | None = None, waves: int = WAVES) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of docs(doc_id, text); table: the model's, if at hand."""
    top = most_frequent(table_rows(m, 2), "c", HOT_PAIRS).select("u", "w", "q", "wc").toPandas()
    u, w = (top[c].to_numpy().astype(np.int64) for c in ("u", "w"))
    key = pair_key(u, w)
    order = np.argsort(key)
    wc = np.where(w >= 0, m.arrays["c"][np.maximum(w, 0)], top["wc"].to_numpy(float))
    context = docs.sparkSession.sparkContext
    pairs = context.broadcast((key[order], top["q"].to_numpy(float)[order], wc[order]))  # HOT_PAIRS pairs at most
    hot = context.broadcast((m.hot, m.arrays["c"]))  # HOT_WORDS words at most
    norm, parts = float(np.log10(m.total + 0.5 * (m.distinct + 1))), m.number
    done = []
    for wave in range(waves):
        mine = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("text"), F.lit(waves)) == wave) if waves > 1 else docs.select("doc_id", "text")
        rows = mine.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        gathered = materialise(rows.mapInArrow(lambda it: _gather(it, *hot.value, pairs.value, parts), _GATHERED), "gathered")
        done.append(materialise(_scored(gathered, _met(gathered, m), norm), "scored"))
        discard(gathered)
    return reduce(DataFrame.unionByName, done)


def perplexity(log10_probability: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -log10_probability / n_tokens)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    held = held_out(F.col("doc_id"), 5, 1)
    m, table = fit(docs.where(~F.coalesce(held, F.lit(False))).select("text"))
    out = score(docs, m, table)
    discard(m.parts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", "score", perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))
