"""Vector links, vector codes and token alignment against plain versions, with odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tidewright.llm")
from tidewright.llm import tokenalign, vectorcodes, vectorlinks  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAN = float("nan")


def vectors(seed=1, copies=70, width=16):
    """Random vectors, a group of near copies larger than a window, chains at the threshold, and odd rows."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [rng.standard_normal(width) for _ in range(150)]
    base = unit(rng.standard_normal(width))
    rows += [base + rng.standard_normal(width) * 0.02 for _ in range(copies)]
    rows += [base + rng.standard_normal(width) * 0.09 for _ in range(60)]
    u, w = unit(rng.standard_normal(width)), rng.standard_normal(width)
    w = unit(w - (w @ u) * u)
    rows += [math.cos(0.3 * k) * u + math.sin(0.3 * k) * w for k in range(12)]
    rows += [rows[0], rows[0], rows[0] * 3.5, rows[1] * 1e-300, rows[2] * 1e200]
    out = [(i, [float(x) for x in v], i % 2 if i < 150 else 0) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * width, [None] + [1.0] * (width - 1), [NAN] * width, [float("inf")] * width, [1.0] * 8, [1.0] * 8, [-0.0] + [1.0] * 7, [0.0] + [1.0] * 7]
    out += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    return out + [(2000, out[0][1], None), (2001, out[0][1], None)]


def brute_links(rows, threshold=0.93):
    links, component, by_label = {v: 0 for v, _, _ in rows}, {v: v for v, _, _ in rows}, defaultdict(list)
    for v, e, label in rows:
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            x = np.array(e) / max(map(abs, e))
            by_label[label, len(e)].append((v, x / np.linalg.norm(x)))

    def root(v):
        while component[v] != v:
            v = component[v]
        return v

    for group in by_label.values():
        for v, x in group:
            for w, y in group:
                if v != w and x @ y >= threshold:
                    links[v] += 1
                    a, b = sorted((root(v), root(w)))
                    component[b] = a
    return sorted((v, links[v], root(v), root(v) == v) for v in links)


SCHEMA = "vec_id long, embedding array<double>, label int, node long, score string"


@pytest.mark.parametrize(("window", "block"), [(32, 512), (4, 16)])
def test_links_equal_all_pairs(spark, window, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = vectorlinks.near_duplicates(df, window=window, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows)
    assert max(n for _, n, _, _ in brute_links(rows)) > 64


def test_links_of_empty_tables_and_unknown_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1, 0, ""), (None, [1.0, 2.0], 1, 0, ""), (7, [1.0, 2.01], 1, 0, ""), (None, [-2.0, 1.0], 1, 0, "")], SCHEMA)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vectorlinks.near_duplicates(df).collect())
    assert got == [("7", 2, 7, True), ("None", 0, None, True), ("None", 2, 7, False), ("None", 2, 7, False)]
    assert vectorlinks.near_duplicates(df.where("1 = 0")).count() == 0


def test_passes_grow_with_the_rows():
    turns = [vectorlinks.plan(n, 64)[0] for n in (1_000, 1_000_000, 100_000_000)]
    assert turns == sorted(turns) and turns[0] < turns[-1]


def brute_codes(rows, rounds=6):
    kept = sorted(((v, e, label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)), key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // 8
    whole = [[math.floor(4096 * x) if abs(x) < 1e290 else int(x) * 4096 for x in e] for _, e, _ in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    book = [[part(v, p) for v in whole[:16]] for p in range(8)]

    def code(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)) for e in book[p]]
        return min(range(len(d)), key=d.__getitem__), min(d)

    for _ in range(rounds):
        found = [[code(v, p)[0] for p in range(8)] for v in whole]
        for p in range(8):
            for e in range(len(book[p])):
                own = [part(v, p) for v, c in zip(whole, found, strict=True) if c[p] == e]
                if own:
                    book[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total, out = Counter(), []
    for (v, _, label), x in zip(kept, whole, strict=True):
        c = [code(x, p) for p in range(8)]
        out.append((v, "".join(f"{i:02x}" for i, _ in c), min(sum(d for _, d in c), 2**63 - 1), label))
        total[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted((v, c, e, min(total[label], 2**63 - 1), sha) for v, c, e, label in out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_codes_equal_plain_rounds(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i // 2 if i < 6 else i, (rng.standard_normal(16) * scale).tolist(), (None, 0, 1)[i % 3]) for i in range(90)]
    rows += [rows[20], rows[20], (500, None, 1), (501, [NAN] * 16, 1), (502, [None] * 16, 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    got = vectorcodes.code_table(df)
    assert sorted(tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == brute_codes(rows)


def test_codes_of_few_odd_and_no_vectors(spark):
    rows = [(1, [0.5] * 8, 0), (2, [1.5] * 8, 0), (3, [1.0] * 9, 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted((r.vec_id, r.code, r.error, r.label_error) for r in vectorcodes.code_table(df).collect())
    assert got == [(1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0), (3, None, None, 0)]
    assert vectorcodes.code_table(df.where("1 = 0")).count() == 0
    assert {r.code for r in vectorcodes.code_table(df.where("vec_id = 3")).collect()} == {None}


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    docs = []
    for doc, text in rows:
        a, b = [], []
        if text:
            found = t.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(byte[c] for c in k)) for i, k in zip(found.ids, found.tokens, strict=True)]
            b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in (model.id_to_piece(i),)]
            if any(b"".join(x for _, x in k) != (" " + text).encode() for k in (a, b)):
                a, b = [], []
        ends = [np.cumsum([len(x) for _, x in k]).tolist() for k in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [tuple([i for (i, _), e in zip(k, at, strict=True) if low < e <= high] for k, at in zip((a, b), ends, strict=True)) for low, high in zip([0, *cuts], cuts, strict=False)]
        docs.append((doc, len(a), len(b), groups))
    count = Counter((x[-1], y[-1]) for d in docs for x, y in d[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for doc, n_a, n_b, groups in docs:
        links = [(x[-1], y[-1]) for x, y in groups]
        s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((str(doc), n_a, n_b, len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return sorted(out)


TEXTS = [None, "", " ", "  two  spaces", "one two", "one two", "naïve café Straße 12,5 km", "漢字かな交じり文 😀👩‍👩‍👧 ok", "x▁y", "▁", "a\n\n\tb\r\n", "<|endoftext|> </s> <s> <unk> <0x41>", "don't we'll 's", " 　​.", "\x00\x01", "é", "word " * 4000, "A" * 3000]


def test_alignment_equals_plain_version(spark):
    rows = [*enumerate(TEXTS), (3, "tied id"), (None, "no id here")]
    docs = spark.createDataFrame([(*r, 5, "n") for r in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    want = brute_alignment(rows)
    for hot in (1 << 20, 40, 0):
        got = tokenalign.alignment_table(docs, A, B, hot).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == want
    assert sum(w[1] == 0 for w in want) >= 4
    assert tokenalign.alignment_table(docs.where("1 = 0"), A, B).count() == 0


def test_groups_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "hello wörld, hellö"), (2, None)], "doc_id long, text string")
    one, none = tokenalign.groups(docs, A, B).orderBy("doc_id").collect()
    assert not any(none[c] for c in ("a_ids", "b_ids", "low", "a_last"))
    va, vb = tokenalign.byte_level(A), tokenalign.pieces(B)
    a_end, b_end = np.cumsum(va.length[one.a_ids]), np.cumsum(vb.length[one.b_ids])
    a_start, b_start = a_end - va.length[one.a_ids], b_end - vb.length[one.b_ids]
    for i in range(len(one.a_ids)):
        assert [j for j in range(len(one.b_ids)) if a_start[i] < b_end[j] and b_start[j] < a_end[i]] == [*range(one.low[i], one.high[i])]
    assert a_end[one.a_last].tolist() == b_end[one.b_last].tolist() == sorted(set(a_end.tolist()) & set(b_end.tolist()))
