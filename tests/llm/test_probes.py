"""Operators and pipeline stages against brute force, held-out rows and odd inputs."""

import hashlib
import os
import zlib

import numpy as np
import pytest

pytest.importorskip("tidewright.llm")
from tidewright.llm import bpe, decontaminate, dom, graph, htmltext, language, media, ngramjoin, sharding, tokenfiles, toxicity  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def crc(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def test_words_of_equal_polynomials_are_told_apart():
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    sets = ngramjoin.shingle_sets([one, other, one])
    assert sets[0][0] == sets[2][0] != sets[1][0]


def test_links_through_rows_without_id(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(1, words), (None, [*words, "x"]), (2, [*words, "x", "y"]), (None, ["alone"]), (3, None), (None, None)]
    docs = spark.createDataFrame([(k, None if w is None else " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngramjoin.near_duplicates(docs).collect()))
    assert got == sorted([("1", 8, "1"), ("None", 9, "1"), ("2", 10, "1"), ("None", 1, "None"), ("3", 0, "3"), ("None", 0, "None")])


def test_hidden_collisions_lose_no_link():
    a = np.array([1, 1, 1, 1, 5, 6, 7], "<u4")  # four tokens with equal 32-bit parts
    assert ngramjoin._share(a.tobytes(), a.tobytes(), 7)
    assert not ngramjoin._share(np.arange(7, dtype="<u4").tobytes(), np.arange(6, 13, dtype="<u4").tobytes(), 3)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(20)] + [(5, 5), (1000, 1001)]
    edges = spark.createDataFrame([(float(a), b) for a, b in path + star], "a double, b long").selectExpr("cast(a as long) as a", "b")
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1021)}
    assert graph.components(edges.where("1 = 0")).count() == 0


@pytest.mark.parametrize(("page", "texts"), [
    ('<p class=a">First paragraph.</p><p class="b">Second paragraph.</p>', ["First paragraph.", "Second paragraph."]),
    ("<p title=it's>one</p><p>two it's</p>", ["one", "two it's"]),
    ("<p a=\"x>y\" b='z>'>three</p>", ["three"]),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]),
])
def test_tags_end_where_the_standard_ends_them(page, texts):
    assert [t for t in dom.parse(page).text if t] == texts


def test_main_text_through_spark(spark):
    body = "".join(f"<p>Sentence number {i} of a long article, which goes on, and on.</p>" for i in range(4000))
    page = f"<html><body><nav><ul><li><a href=/>home</a></li></ul></nav><article><h1>Title</h1>{body}</article><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "y"), (2, None, None, None), (None, "v", "", None), (3, "w", "<p", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(pages.withColumnRenamed("text", "tag"), ["page_id", "url"]).collect()
    texts = [r.text for r in got]
    assert len(got) == 5 and texts[0] == texts[1] and texts[0].count("\n\n") == 4000 and texts[2:4] == ["", ""]
    assert htmltext.extract(pages.where("1 = 0"), ["page_id", "url"]).count() == 0


def _labelled(spark, n=120):
    rows = [(i, f"you {'idiot fool' if i % 4 == 0 else 'nice friend'} number w{i} of the day " * 3) for i in range(n)]
    labels = [(i, int(i % 4 == 0)) for i in range(n)]
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string")


def test_toxicity_learns_only_from_rows_that_are_there_and_not_held_out(spark):
    rows, labels, docs = _labelled(spark)
    strange = [(10**6 + i, 1) for i in range(5000)]
    plain = spark.createDataFrame([(*x, None) for x in labels], "doc_id long, toxic int, text string")
    more = spark.createDataFrame([(*x, None) for x in labels + strange], "doc_id long, toxic int, text string")
    turned = spark.createDataFrame([(k, 1 - y if crc(k, 5) == 0 else y, None) for k, y in labels], "doc_id long, toxic int, text string")
    want = sorted((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.score_documents(docs, plain).collect())
    for other in (more, turned):
        assert sorted((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.score_documents(docs, other).collect()) == want
    assert all(h == (crc(k, 5) == 0) and p == (s >= 0.5) for k, h, s, p in want)
    wrong = sum(p != (k % 4 == 0) for k, h, _, p in want if h)
    assert wrong == 0 and sum(h for _, h, _, _ in want) > 10
    assert toxicity.score_documents(docs.where("1 = 0"), plain).count() == 0
    assert {r.predicted for r in toxicity.score_documents(docs, plain.where("1 = 0")).collect()} == {0}


def test_language_learns_no_held_out_row(spark):
    words = {"en": "the cat and the dog of this house", "de": "der hund und die katze im haus nicht"}
    rows = [(i, f"{words['en' if i % 2 else 'de']} {i}", "en" if i % 2 else "de") for i in range(90)] + [(200, None, "en"), (201, " 12 !", None), (None, words["en"], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in language.identify_documents(docs).collect())
    turned = spark.createDataFrame([(k, t, "zz" if k is not None and crc(k, 3) == 1 else x) for k, t, x in rows], "doc_id long, text string, lang string")
    assert got == sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in language.identify_documents(turned).collect())
    by_key = {k: (h, p, s) for k, h, p, s in got}
    assert by_key["200"][1:] == by_key["201"][1:] == ("und", 0.0)
    assert all(by_key[str(i)][1] == ("en" if i % 2 else "de") for i in range(90) if crc(i, 3) == 1)
    assert all(0 <= s <= 1 for _, _, _, s in got) and by_key["0"][0] == (crc(0, 3) == 1)
    assert language.identify_documents(docs.where("1 = 0")).count() == 0


def test_shards_equal_brute_force(spark):
    import struct

    import xxhash

    rows = [(i, None if i % 7 == 0 else "é" * i) for i in range(150)] + [(3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs.drop("shard"), [1.0] * 40).collect()

    def place(key, shards):
        def score(i):
            h = xxhash.xxh64(struct.pack("<q", i), xxhash.xxh64(str(key).encode(), 42).intdigest()).intdigest()
            return -np.log(((h >> 12) + 0.5) / 2**52)

        return min(range(shards), key=score)

    want = sorted((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", place(k, 40), place(k, 41)) for k, t in rows)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.law, r["shard"], r.grown_shard) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_token_files_have_the_layout_asked_for(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"text number {i} of the set " * (i % 9)) for i in range(400)], "doc_id long, text string")
    out = str(tmp_path / "tokens")
    tokenfiles.write_tokens(docs, JSON, out, 3)
    files = sorted(f for f in os.listdir(out) if f.endswith(".parquet"))
    ends = []
    for f in files:
        meta = pq.ParquetFile(f"{out}/{f}").metadata
        group = meta.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["local_start"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        keys = pq.read_table(f"{out}/{f}", columns=["doc_id"]).column("doc_id").to_pylist()
        assert keys == sorted(keys)
        ends.append((keys[0], keys[-1]))
    assert sorted(ends) == sorted(ends, key=lambda x: x[1])
    part = tokenfiles.read_tokens(spark, out, 100, 119, ["doc_id", "n_tokens"])
    assert sorted(r.doc_id for r in part.collect()) == list(range(100, 120))
    total, start = 0, {r.doc_id: r.start for r in tokenfiles.starts(spark, out).collect()}
    for r in sorted(tokenfiles.read_tokens(spark, out).collect(), key=lambda r: r.doc_id):
        assert start[r.doc_id] == total and len(r.ids) == r.n_tokens and r.ids[-1] == 0
        total += r.n_tokens


def test_payload_columns_equal_the_library(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "x" * 65, "word " * 9000, "word " * 9000]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = sorted(media.read_back(media.store_payload(docs)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    want = sorted(enumerate(texts), key=lambda x: (x[0] == 5, x[0]))
    for r, (_, t) in zip(got, want, strict=True):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert [r.media_sha256 for r in got[-3:-1]] == [got[-3].media_sha256] * 2 and got[-3].feature == got[-2].feature
    assert media.read_back(media.store_payload(docs.where("1 = 0"))).count() == 0


def test_other_names_units_and_scripts_are_caught(spark):
    item = "Then Anna walks 12 km to the old mill in 3 hours and asks how fast she went"
    bench = spark.createDataFrame([(1, item, "x"), (2, "東京から大阪まで五百キロあります", "x"), (None, "two words", "x"), (4, None, "x")], "item_id long, text string, note string")
    docs = spark.createDataFrame([
        (1, "Intro. " + item.replace("Anna", "Maria").replace("12 km", "40 miles").replace("3 hours", "7 hours") + " today.", 5),
        (2, "昨日、東京から大阪まで五百キロありますと聞いた。", 5), (2, "other text of the same key", 5), (3, "these two words stand here", 5), (3, "these two words stand here", 5), (4, None, 5), (5, "東京 から", 5),
    ], "doc_id long, text string, item_id long")
    got = sorted((r.doc_id, str(r.item_id), r.changed_slots) for r in decontaminate.contamination(docs.drop("item_id"), bench).collect())
    assert got == [(1, "1", True), (2, "2", False), (3, "None", False)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of tables: clean texts in two languages, toxic ones, copies, benchmark passages, texts without letters."""
    rng = np.random.default_rng(3)
    en, de = "the cat and dog of this house is here with a small red ball".split(), "der hund und die katze im haus ist nicht hier bei dem ball".split()
    rows, labels = [], []
    for i in range(160):
        base = en if i % 2 else de
        text = " ".join([*rng.choice(base, 40), *[f"{base[0]}x{chr(97 + int(x))}{chr(97 + int(y))}" for x, y in rng.integers(0, 26, (12, 2))]])
        if i % 8 == 0:
            text += " you stupid idiot fool"
        rows.append([i, text, "en" if i % 2 else "de", "s", len(text)])
        labels.append((i, 1, int(i % 8 == 0)))
    item = "A farmer has 12 sheep and buys 30 more at the market how many sheep has the farmer now"
    rows += [[200 + i, rows[i * 2 + 1][1] + (" tail" if i % 2 else ""), "en", "s", 1] for i in range(10)]  # near and exact copies
    rows += [[300, rows[3][1] + " " + item, "en", "s", 1], [301, "12 345 !!", None, "s", 1], [302, None, None, "s", 1], [303, "", "en", "s", 1], [7, "another text of key seven with a cat and a dog in this house", "en", "s", 1], [7, rows[7][1], "en", "s", 1]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_pipeline_stages_against_brute_force(spark, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def keys(df):
        return sorted((str(r.doc_id), str(r.text)) for r in df.select("doc_id", "text").collect())

    def expected(keep):
        return sorted((str(r[0]), str(r[1])) for r in rows if keep(r))

    bad = lambda r: r[1] is not None and "idiot" in r[1]
    got = stages["toxicity"](spark, docs, folder)
    assert got.columns == corpus_pipeline.COLUMNS and keys(got) == expected(lambda r: not bad(r))
    got = stages["language"](spark, docs, folder)
    assert keys(got) == expected(lambda r: r[1] and any(c.isalpha() for c in r[1]))
    mixed = spark.createDataFrame([(900, "the cat and the dog der hund und die katze zed yon xal wub qip", "en", "s", 1)], docs.schema)
    assert stages["language"](spark, docs.unionByName(mixed), folder).where("doc_id = 900").count() == 1
    # one row of each group: the least key, then the least hash; other texts of a key stay
    got = keys(stages["near_copies"](spark, docs, folder))
    sets = [s.tobytes() for s in ngramjoin.shingle_sets([r[1] or "" for r in rows])]
    tokens = [set(np.frombuffer(s, np.uint64).tolist()) for s in sets]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(tokens[i] & tokens[j])
            if both and 100 * both >= 80 * len(tokens[i] | tokens[j]):
                top[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r[0]), r[0])
    assert len(got) == sum(not t for t in tokens) + len({find(i) for i in range(len(rows)) if tokens[i]})
    assert {k for k, t in got} == {str(rows[i][0]) for i in range(len(rows)) if not tokens[i]} | {str(v) for i, v in best.items() if tokens[i]}
    got = stages["decontamination"](spark, docs, folder)
    assert keys(got) == expected(lambda r: not (r[1] and "farmer" in r[1]))
    got = {str(r.doc_id) + str(r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in stages["byte_bpe"](spark, docs, folder).collect()}
    for r in rows:
        n, a, b = bpe.reference_digest(r[1], RANKS)
        assert got[str(r[0]) + str(n)] == (a, b)
    nothing = docs.where("1 = 0")
    assert all(stage(spark, nothing, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_runs_its_stages_in_turn(spark, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder, rows = corpus
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    clean = {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1]) and "idiot" not in r[1] and "farmer" not in r[1]}
    assert got <= clean and {r[0] for r in rows[:160] if r[0] in clean} <= got
